"""DuckDB SQL that must give the same rows as the registered queries."""

from __future__ import annotations


#: The views' present, 2024-02-01, in milliseconds.
NOW = 1_706_745_600_000
#: Fixed values, written out here so that a wrong one in the operators does not pass: patterns, advice, ranks and texts.
PLATFORMS = [
    ("bilibili", r"bilibili\.com|b23\.tv|bili[a-z]*\.com"),
    ("youtube", r"youtube\.com|youtu\.be|googlevideo\.com"),
    ("douyin", r"douyin\.com|tiktok\.com"),
    ("xiaohongshu", r"xiaohongshu\.com|xhslink\.com"),
    ("twitter", r"twitter\.com|x\.com"),
]
RETRYABLE = "(?i)timeout|timed out|socket|network|ECONN|ETIMEDOUT|429|rate|Too Many|500|502|503|504|Bad Gateway|Service Unavailable"
REJECTED = "(?i)HTTP Error 412|Precondition Failed"
SSL = "(?i)UNEXPECTED_EOF_WHILE_READING|SSLError|SSL"
AUTH = "(?i)unauthorized|invalid api[-_ ]?key|401"
ENCOURAGEMENTS = [
    (2, "First Steps Count", "Your brain is already responding to the decision. Keep the next hour simple and protect your focus."),
    (7, "Momentum Is Building", "You may notice clearer energy and a little more control over urges. Small choices are starting to stack up."),
    (14, "One Week Strong!", "A full week is a major milestone. Your brain is beginning to heal. You might notice improved focus and energy. This is just the beginning."),
    (None, "Deeper Reset", "Your discipline is becoming part of your identity. Expect steadier confidence, better attention, and more space between urges and action."),
]
RANKS = [
    (90, 10),
    (60, 25),
    (34, 40),
    (16, 55),
    (None, 72),
]
REJECTED_LINES = [
    "B 站拒绝了 yt-dlp 的网页请求：HTTP 412 Precondition Failed。",
    "这通常需要带上你本人浏览器里的 B 站登录 cookies。",
    '优先尝试在 Chrome 登录 B 站后设置：YTDLP_EXTRA_ARGS="--no-update --cookies-from-browser chrome --user-agent Mozilla/5.0 --referer https://www.bilibili.com/"。',
    '如果读取浏览器 cookies 失败，再导出 Netscape 格式 cookies.txt 放到项目根目录，并设置：YTDLP_EXTRA_ARGS="--no-update --cookies cookies.txt"。',
]
SSL_LINES = [
    "yt-dlp 下载视频时 SSL 连接被中断。",
    "我已经自动尝试了普通下载、IPv4、legacy TLS 和跳过证书校验，但仍未成功。",
    "这可能是网络连接、代理/VPN、证书链或平台反爬机制导致的。",
    '可以在 .env 里设置 YTDLP_EXTRA_ARGS，例如：YTDLP_EXTRA_ARGS="--proxy http://127.0.0.1:7890 --cookies-from-browser chrome"。',
]
ORIGINAL_ERROR = "原始错误："
UNTITLED_QUESTION = "未命名视频"

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def r1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


def whole(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def hours(x: str) -> str:
    return f"CAST(greatest(0, {whole(f'({x}) * 24')}) AS VARCHAR) || 'h'"


def label(x: str) -> str:
    return f"CASE WHEN {r1(x)} < 1 THEN {hours(x)} ELSE CAST({whole(r1(x))} AS VARCHAR) || 'd' END"


def compact(x: str) -> str:
    return f"CASE WHEN ({x}) < 1 THEN {hours(x)} ELSE CAST({whole(x)} AS VARCHAR) || 'd' END"


def steps(x: str, rows: list[tuple], k: int, op: str) -> str:
    value = lambda r: lit(r[k]) if isinstance(r[k], str) else str(r[k])
    return "CASE " + " ".join(f"WHEN {x} {op} {r[0]} THEN {value(r)}" for r in rows[:-1]) + f" ELSE {value(rows[-1])} END"


def platform(url: str, other: str = "generic") -> str:
    host = f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    return "CASE " + " ".join(f"WHEN regexp_matches({host}, '{p}') THEN '{n}'" for n, p in PLATFORMS) + f" ELSE '{other}' END"


USERS = "u AS (SELECT user_id, epoch_us(min(ts)) // 1000 AS started_ms FROM events GROUP BY user_id)"
RELAPSES = "rel AS (SELECT user_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type = 'error')"


def streaks_of(users: str = "u", relapses: str = "rel") -> str:
    return f"""
    r AS (SELECT DISTINCT user_id, ts_ms FROM {relapses} JOIN {users} USING (user_id) WHERE ts_ms > started_ms AND ts_ms <= {NOW}),
    ends AS (SELECT user_id, ts_ms AS end_ms, false AS current FROM r UNION ALL SELECT user_id, {NOW}, true FROM {users}),
    st AS (SELECT user_id, CAST(row_number() OVER w AS INTEGER) AS id, coalesce(lag(end_ms) OVER w, started_ms) AS start_ms, end_ms, current
           FROM ends JOIN {users} USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY end_ms, current)),
    s AS (SELECT *, greatest(0.0::DOUBLE, (end_ms - start_ms)::DOUBLE / 86400000.0::DOUBLE) AS days FROM st)"""


STATS = f"""
    g AS (SELECT user_id, count(*) - 1 AS n, max(days) AS best, avg(days) AS av, max(CASE WHEN current THEN days END) AS cur FROM s GROUP BY user_id)
    SELECT user_id, n AS relapse_count, {r1('cur')} AS current_days, {label('cur')} AS current_label, {r1('best')} AS best_days, {compact('best')} AS best_label,
        {r1('av')} AS avg_days, {compact('av')} AS avg_label, CAST({steps('(cur * 6 + best * 4 - n * 5)', RANKS, 1, '>=')} AS INTEGER) AS rank_percent,
        greatest(1, {whole('cur + best / 2')}) AS karma, {steps(r1('cur'), ENCOURAGEMENTS, 1, '<')} AS title, {steps(r1('cur'), ENCOURAGEMENTS, 2, '<')} AS body FROM g"""
BASE = f"WITH {USERS}, {RELAPSES}, {streaks_of()}"

TOTALS = "tot AS (SELECT o_orderkey AS job_id, CAST(o_orderkey % 7 + 1 AS INTEGER) AS total_chunks FROM orders)"
LATEST = """lat AS (SELECT job_id, chunk_idx, text, l_extendedprice FROM (SELECT l_orderkey AS job_id, CAST(l_linenumber - 1 AS INTEGER) AS chunk_idx,
    CASE WHEN l_linestatus = 'F' THEN 'x' WHEN l_suppkey % 2 = 0 THEN '' ELSE '  ' END AS text, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1)"""
PLAN = "plan AS (SELECT job_id, CAST(unnest(range(total_chunks)) AS INTEGER) AS chunk_idx, total_chunks FROM tot)"
PROGRESS = f"""
    done AS (SELECT job_id, chunk_idx FROM lat WHERE {trim('text')} <> ''),
    prog AS (SELECT p.job_id, any_value(p.total_chunks) AS total_chunks, count(d.chunk_idx) AS completed, max(d.chunk_idx) AS last_completed,
        min(CASE WHEN d.chunk_idx IS NULL THEN p.chunk_idx END) AS next_incomplete
        FROM plan p LEFT JOIN done d ON p.job_id = d.job_id AND p.chunk_idx = d.chunk_idx GROUP BY p.job_id)"""
PCT = "CASE WHEN total_chunks = 0 THEN 0 ELSE CAST(floor(100.0::DOUBLE * completed / total_chunks + 0.5) AS BIGINT) END"

URLS = ["https://www.bilibili.com/video/BV", "https://b23.tv/", "https://youtu.be/", "https://www.YouTube.com/watch?v=", "https://www.tiktok.com/@a/video/", "http://xhslink.com/", "https://x.com/a/status/"]
SUBMISSIONS = "sub AS (SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {k} THEN '{u}' || (page_id % 50)" for k, u in enumerate(URLS)) + " ELSE url END AS url FROM pages)"

MEDIA = "med AS (SELECT doc_id AS job_id, CAST(n_chars AS DOUBLE) AS d FROM documents)"
MANIFEST = """man AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 5 = 0 THEN 'audio' ELSE 'video' END AS kind, greatest(1, CAST(ceil(n_chars / 120) AS INTEGER)) AS total_chunks,
    CASE WHEN doc_id % 7 = 0 THEN 60 ELSE 120 END AS chunk_seconds, CAST(n_chars + doc_id % 4 - 1 AS DOUBLE) AS d, CAST(n_chars AS DOUBLE) AS probe FROM documents)"""

DAYS = "epoch_us(ts) // 1000 // 86400000"
NUMBERED = f"num AS (SELECT *, {DAYS} AS day, CAST(row_number() OVER (PARTITION BY user_id, {DAYS} ORDER BY event_id) AS INTEGER) AS n FROM events)"
RETRY = f"regexp_matches(coalesce(error, ''), {lit(RETRYABLE)})"
K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
LOG = """lg AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'error' WHEN event_type = 'purchase' THEN 'done' ELSE 'status' END AS type,
    event_type AS step, props AS message, CASE WHEN event_type IN ('view', 'click') THEN value END AS progress FROM events)"""
FOLD = f"""WITH {LOG}, stop AS (SELECT job_id, min(CASE WHEN type = 'error' THEN seq END) AS stop FROM lg GROUP BY job_id),
    e AS (SELECT lg.* FROM lg JOIN stop USING (job_id) WHERE stop IS NULL OR seq <= stop)
    SELECT job_id, arg_max(message, seq) FILTER (message <> '') AS message,
        arg_max(CASE WHEN type = 'done' THEN 100.0::DOUBLE ELSE least(100, greatest(0, progress)) END, seq) FILTER (progress IS NOT NULL OR type = 'done') AS progress,
        arg_max(step, seq) FILTER (progress IS NOT NULL) AS step, bool_or(type = 'done') AS done, CASE WHEN bool_or(type = 'error') THEN '未知错误' END AS error, max(seq) AS last_seq
    FROM e GROUP BY job_id"""

Q_JOB = "substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)"
QUESTIONS = f"""q AS (SELECT doc_id AS question_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Q' || doc_id END AS question, CASE WHEN doc_id % 17 <> 0 THEN {Q_JOB} END AS job_id,
    text, doc_id % 19 <> 0 AS has, CASE WHEN doc_id % 3 <> 0 THEN source END AS title FROM documents),
    a AS (SELECT *, CASE WHEN question = '' THEN 400 WHEN job_id IS NULL OR NOT has THEN 404 WHEN {trim('text')} = '' THEN 400 ELSE 200 END AS code FROM q)"""
LIMITED = f"(CASE WHEN length({trim('text')}) > 90000 THEN substr({trim('text')}, 1, 90000) || chr(10) || chr(10) || '[文稿过长，已截取前 90000 个字符用于本次问答]' ELSE {trim('text')} END)"
PROMPT = f"'视频标题：' || coalesce(title, '{UNTITLED_QUESTION}') || chr(10) || '来源链接：https://youtu.be/1' || chr(10) || '视频文稿：' || chr(10) || {LIMITED} || chr(10) || '问题：' || question"

CHECKPOINT_TOTAL = "CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN CAST(k % 7 + 1 AS INTEGER) WHEN k % 2 = 0 THEN CAST(k % 7 + 1 AS INTEGER) ELSE 0 END"
STATUS = f"""{LATEST}, o AS (SELECT o_orderkey AS k, * FROM orders), b AS (SELECT k AS job_id, {CHECKPOINT_TOTAL} AS total_chunks, * FROM o),
    dn AS (SELECT job_id, chunk_idx FROM lat WHERE {trim('text')} <> ''),
    kept AS (SELECT b.job_id, d.chunk_idx FROM b JOIN dn d ON b.job_id = d.job_id WHERE b.total_chunks = 0 OR d.chunk_idx < b.total_chunks),
    c AS (SELECT job_id, count(*) AS completed, max(chunk_idx) AS last FROM kept GROUP BY job_id),
    nx AS (SELECT p.job_id, min(p.i) AS nxt FROM (SELECT job_id, CAST(unnest(range(total_chunks)) AS INTEGER) AS i FROM b) p LEFT JOIN kept ON p.job_id = kept.job_id AND p.i = kept.chunk_idx WHERE kept.job_id IS NULL GROUP BY p.job_id),
    tr AS (SELECT job_id, string_agg('## Chunk ' || (chunk_idx + 1) || chr(10) || chr(10) || 'x', chr(10) || chr(10) ORDER BY chunk_idx) AS transcript FROM dn GROUP BY job_id),
    st AS (SELECT b.job_id, CASE WHEN k % 5 <> 0 THEN 'https://youtu.be/' || k ELSE '' END AS source_url,
        CASE WHEN k % 4 <> 0 AND k % 6 <> 0 THEN o_orderpriority WHEN k % 5 <> 0 THEN 'stored' ELSE '' END AS title,
        CASE WHEN k % 4 <> 0 AND o_orderstatus = 'O' THEN 'transcribing' WHEN k % 4 <> 0 AND o_orderstatus = 'F' THEN 'complete' ELSE 'unknown' END AS status, total_chunks,
        coalesce(completed, 0) AS completed_chunks, CASE WHEN k % 4 <> 0 AND o_orderstatus = 'O' THEN CAST(k % 5 AS INTEGER) END AS current_chunk,
        last AS last_completed_chunk, nxt AS next_resume_chunk, coalesce(transcript, '') AS transcript_preview,
        CASE WHEN k % 4 <> 0 AND k % 9 = 0 THEN 'HTTP 503' ELSE '' END AS error, CASE WHEN k % 5 <> 0 THEN '2024-01-01' ELSE '' END AS updated_at
        FROM b LEFT JOIN c USING (job_id) LEFT JOIN nx USING (job_id) LEFT JOIN tr USING (job_id))"""
ECHO = lambda x: f"""CASE WHEN {x} % 10 <> 0 THEN NULL WHEN {x} % 20 = 0 THEN 'HTTP 503' ELSE 'invalid input' END AS error,
    CAST(CASE WHEN {x} % 20 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts"""  # noqa: E731

ERROR_TEXT = "CASE doc_id % 10 WHEN 0 THEN 'HTTP Error 412 ' || text WHEN 1 THEN 'SSLError ' || text ELSE text END"

ORACLE = {
    "streak_stats": f"{BASE}, {STATS}",
    "streak_normalize": f"{BASE} SELECT user_id, ts_ms FROM r",
    "streaks": f"{BASE} SELECT user_id, id, start_ms, end_ms, CASE WHEN NOT current THEN end_ms END AS relapse_ms, days, current FROM s",
    "progress_points": f"{BASE} SELECT user_id, id, {r1('days')} AS days, CASE WHEN current THEN 'progress' ELSE 'relapse' END AS type, {compact('days')} AS label, end_ms AS at_ms FROM s",
    "streak_report": f"""{BASE}, g AS (SELECT user_id, CAST(count(*) - 1 AS INTEGER) AS n_relapses, max(days) AS best, max(CASE WHEN current THEN days END) AS cur FROM s GROUP BY user_id)
        SELECT user_id, {label('cur')} AS current_label, n_relapses, greatest(1, {whole('cur + best / 2')}) AS karma, id, {r1('days')} AS days, {compact('days')} AS label,
            CASE WHEN current THEN 'progress' ELSE 'relapse' END AS type, end_ms AS at_ms FROM s JOIN g USING (user_id)""",
    "streak_seeded": f"""WITH {RELAPSES}, cu AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 1 THEN {NOW - 13 * 86400000} ELSE {NOW - 34 * 86400000} END AS started_ms, c_custkey % 3 <> 1 AS seeded FROM customer),
        relu AS (SELECT rel.user_id, ts_ms FROM rel JOIN cu USING (user_id) WHERE NOT seeded
            UNION ALL SELECT user_id, {NOW} - 86400000 * CAST(unnest([31, 30, 27, 19, 12, 7]) AS BIGINT) FROM cu WHERE seeded), {streaks_of('cu', 'relu')}, {STATS}""",
    "record_relapse": f"""WITH {RELAPSES}, u0 AS (SELECT user_id, epoch_us(min(ts)) // 1000 AS started_ms FROM events GROUP BY user_id),
        u AS (SELECT * FROM u0 WHERE user_id IN (SELECT user_id FROM rel WHERE ts_ms > {NOW - 7 * 86400000})), {streaks_of()}
        SELECT user_id, id, start_ms, end_ms, CASE WHEN NOT current THEN end_ms END AS relapse_ms, days, current FROM s""",
    "chunk_plan": f"""WITH {MEDIA}, n AS (SELECT job_id, d, CASE WHEN d <= 120 THEN 1 ELSE CAST(ceil(d / 120) AS INTEGER) END AS total_chunks FROM med WHERE d > 0),
        x AS (SELECT *, CAST(unnest(range(total_chunks)) AS INTEGER) AS chunk_idx FROM n)
        SELECT job_id, chunk_idx, CAST(120 * chunk_idx AS DOUBLE) AS start_s, least(120.0::DOUBLE * (chunk_idx + 1), d) AS end_s, total_chunks, d <= 120 AS single_file FROM x""",
    "latest_result": f"WITH {LATEST} SELECT * FROM lat",
    "pending_chunks": f"WITH {TOTALS}, {PLAN}, {LATEST} SELECT job_id, chunk_idx, total_chunks FROM plan WHERE (job_id, chunk_idx) NOT IN (SELECT (job_id, chunk_idx) FROM lat WHERE text <> '')",
    "pending_chunks_strict": f"WITH {TOTALS}, {PLAN}, {LATEST} SELECT job_id, chunk_idx, total_chunks FROM plan WHERE (job_id, chunk_idx) NOT IN (SELECT (job_id, chunk_idx) FROM lat WHERE {trim('text')} <> '')",
    "chunk_progress": f"WITH {TOTALS}, {PLAN}, {LATEST}, {PROGRESS} SELECT *, {PCT} AS progress FROM prog",
    "final_checkpoint": f"WITH {TOTALS}, {PLAN}, {LATEST}, {PROGRESS} SELECT job_id, 'complete' AS status, total_chunks, total_chunks AS completed_chunks, total_chunks > completed AS forced_complete FROM prog",
    "transcript_rebuild": f"""WITH c AS (SELECT conv_id AS job_id, turn AS chunk_idx, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE {trim('text')} END AS text FROM conversations)
        SELECT job_id, coalesce(string_agg('## Chunk ' || (chunk_idx + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (text <> ''), '') AS transcript FROM c GROUP BY job_id""",
    "manifest_build": f"""WITH {MANIFEST}, f AS (SELECT job_id, probe, unnest(range(total_chunks)) AS i FROM man), h AS (SELECT * FROM f WHERE job_id % 11 <> 0 OR i <> 0)
        SELECT job_id, 'video' AS kind, CAST(count(*) AS INTEGER) AS total_chunks, 120 AS chunk_seconds, any_value(probe) AS duration_seconds,
            string_agg('chunk-' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INTEGER), '0') || '.mp4', ',' ORDER BY 'chunk-' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INTEGER), '0') || '.mp4') AS chunks, any_value(probe) <= 120 AS single_file FROM h GROUP BY job_id""",
    "manifest_reuse": f"WITH {MANIFEST} SELECT job_id, total_chunks, d AS duration_seconds FROM man WHERE kind = 'video' AND chunk_seconds = 120 AND abs(d - probe) <= 1 AND job_id % 11 <> 0",
    "platform_mix": f"WITH {SUBMISSIONS} SELECT {platform('url')} AS platform, {platform('url', 'web')} AS label, count(*) AS n FROM sub GROUP BY 1, 2",
    "job_ids": f"WITH {SUBMISSIONS} SELECT page_id, substr(sha256({trim('url')}), 1, 16) AS job_id, true AS valid FROM sub",
    "dedupe_submissions": f"WITH {SUBMISSIONS} SELECT substr(sha256({trim('url')}), 1, 16) AS job_id, min({trim('url')}) AS source_url, {platform(f'min({trim(chr(117) + chr(114) + chr(108))})')} AS platform FROM sub GROUP BY 1",
    "limit_text": "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '[文稿过长，已截取前 1000 个字符用于本次问答]' ELSE text END AS text FROM documents",
    "transcript_preview": f"SELECT doc_id, substr({trim('text')}, 1, 2000) AS preview FROM documents",
    "safe_filename": f"""SELECT doc_id, substr(regexp_replace(regexp_replace(concat_ws('-', nullif(text, ''), CASE WHEN doc_id % 3 = 1 THEN nullif(source, '') END, nullif(lang, '')), '[\\\\/:*?"<>|]', '_', 'g'), '{WS}+', '_', 'g'), 1, 120) AS name FROM documents""",
    "export_names": f"""WITH x AS (SELECT doc_id AS job_id, length(text) AS n_chars, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 AND text <> '' THEN text ELSE 'transcript' END AS title,
            CASE WHEN doc_id % 5 <> 0 THEN nullif(source, '') END AS uploader, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'youtube' ELSE 'web' END AS platform FROM documents WHERE doc_id % 11 <> 0)
        SELECT job_id, substr(regexp_replace(regexp_replace(concat_ws('-', title, uploader, platform), '[\\\\/:*?"<>|]', '_', 'g'), '{WS}+', '_', 'g'), 1, 120) AS file_name, n_chars FROM x""",
    "checkpoint_fold": f"""WITH p AS (SELECT user_id AS job_id, event_type AS key, CASE WHEN {K} % 10 <> 0 THEN CAST({K} AS VARCHAR) END AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
        SELECT job_id, {', '.join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in ("view", "click", "purchase", "signup", "error"))} FROM p WHERE n = 1 GROUP BY job_id""",
    "job_status": f"""WITH {STATUS} SELECT job_id, source_url, title, status, total_chunks, completed_chunks, current_chunk, current_chunk + 1 AS current_chunk_human, last_completed_chunk, last_completed_chunk + 1 AS last_completed_chunk_human,
        next_resume_chunk, next_resume_chunk + 1 AS next_resume_chunk_human, CASE WHEN total_chunks = 0 THEN 0 ELSE CAST(floor(100.0::DOUBLE * completed_chunks / total_chunks + 0.5) AS BIGINT) END AS progress, transcript_preview, error, '' AS last_chunk_error, updated_at FROM st""",
    "job_summary": f"""WITH {STATUS} SELECT job_id, completed_chunks || '/' || total_chunks AS summary, CASE WHEN next_resume_chunk IS NOT NULL THEN 'resume ' || (next_resume_chunk + 1) WHEN total_chunks > 0 AND completed_chunks >= total_chunks THEN 'done'
        WHEN current_chunk IS NOT NULL THEN 'running ' || (current_chunk + 1) ELSE 'not started' END AS next, completed_chunks > 0 AND completed_chunks >= greatest(total_chunks, 1) AS downloadable FROM st""",
    "recent_log": f"WITH {LOG}, x AS (SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS INTEGER) AS rank, seq, message FROM lg WHERE message <> '') SELECT * FROM x WHERE rank <= 8",
    "event_fold": FOLD,
    "stream_job_state": FOLD,
    "error_classes": f"""WITH {SUBMISSIONS}, x AS (SELECT doc_id, {ERROR_TEXT} AS m, coalesce(url, '') AS url FROM documents LEFT JOIN sub ON doc_id = page_id),
        y AS (SELECT *, CASE WHEN {platform('url')} = 'bilibili' AND regexp_matches(m, {lit(REJECTED)}) THEN 'platform_rejected' WHEN regexp_matches(m, {lit(SSL)}) THEN 'ssl' ELSE 'other' END AS category FROM x)
        SELECT doc_id, regexp_matches(m, {lit(RETRYABLE)}) AS retryable, regexp_matches(m, {lit(AUTH)}) AS auth, category,
            md5(CASE category WHEN 'platform_rejected' THEN {' || chr(10) || '.join(map(lit, [*REJECTED_LINES, ORIGINAL_ERROR]))} WHEN 'ssl' THEN {' || chr(10) || '.join(map(lit, [*SSL_LINES, ORIGINAL_ERROR]))} ELSE '' END || m) AS message_md5 FROM y""",
    "api_errors": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'code=' || event_type || '; message=m' || event_id || '; error=bad' WHEN 1 THEN 'request_id=r' || event_id ELSE 'HTTP 500' END AS detail FROM events",
    "retry_outcome": f"""WITH {NUMBERED}, a AS (SELECT user_id AS job_id, day AS chunk_idx, n AS attempt, CASE event_type WHEN 'error' THEN 'HTTP 503' WHEN 'signup' THEN 'invalid input' END AS error FROM num WHERE n <= 3),
        e AS (SELECT *, min(CASE WHEN error IS NULL OR NOT {RETRY} OR attempt >= 3 THEN attempt END) OVER (PARTITION BY job_id, chunk_idx) AS fin FROM a),
        k AS (SELECT * FROM e WHERE fin IS NULL OR attempt <= fin), l AS (SELECT *, row_number() OVER (PARTITION BY job_id, chunk_idx ORDER BY attempt DESC) AS z FROM k)
        SELECT job_id, chunk_idx, count(*) AS attempts, CASE WHEN any_value(fin) IS NULL THEN 'in_progress' WHEN max(CASE WHEN z = 1 THEN coalesce(error, '-') END) = '-' THEN 'ok' WHEN max(CASE WHEN z = 1 THEN error END) = 'HTTP 503' THEN 'failed_exhausted' ELSE 'failed_permanent' END AS state,
            CAST(coalesce(sum(CASE WHEN fin IS NULL OR attempt < fin THEN attempt * 1000 END), 0) AS BIGINT) AS backoff_ms FROM l GROUP BY job_id, chunk_idx""",
    "first_success": f"""WITH {NUMBERED}, a AS (SELECT user_id || '-' || day || '-' || ((n - 1) // 4) AS job_id, event_type, (n - 1) % 4 + 1 AS n FROM num),
        g AS (SELECT job_id, min(CASE WHEN event_type IN ('view', 'click') THEN n END) AS w, count(*) AS c, arg_max(event_type, n) AS last FROM a GROUP BY 1)
        SELECT job_id, (['default', 'ipv4', 'legacy_tls', 'ipv4_no_certificate_check'])[w] AS winner, CAST(coalesce(w - 1, c) AS BIGINT) AS failovers, CASE WHEN w IS NULL THEN last END AS error FROM g""",
    "durations": """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN CAST(event_id % 300 - 150 AS DOUBLE) ELSE event_id % 900 + 0.5::DOUBLE END AS seconds FROM events)
        SELECT event_id, seconds, coalesce(seconds > 0, false) AS valid FROM x""",
    "chunk_names": "SELECT DISTINCT l_orderkey AS job_id, printf('chunk-%03d.txt', CAST((l_linenumber - 1) * 250 AS INTEGER)) AS name FROM lineitem",
    "titles": f"""WITH {SUBMISSIONS} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'kept' ELSE url END AS title,
        CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'someone' ELSE '' END WHEN page_id % 4 <> 0 THEN 'uploader' ELSE '' END AS uploader FROM sub""",
    "chunk_requests": "WITH x AS (SELECT doc_id, 'data:video/mp4;base64,' || base64(encode(text)) AS u FROM documents) SELECT doc_id, length(u) AS encoded_bytes, length(u) > 29360128 AS over_limit, md5(u) AS url_md5 FROM x",
    "sse_text": f"SELECT conv_id, {trim('string_agg(text, %s ORDER BY turn)' % lit(''))} AS text, false AS parse_error FROM conversations GROUP BY conv_id",
    "chat_text": f"SELECT conv_id, turn, nullif({trim('text')}, '') AS text, CASE WHEN {trim('text')} = '' THEN 'no_text' END AS error FROM conversations",
    "locate_job": f"WITH {QUESTIONS} SELECT question_id, CASE WHEN has THEN job_id END AS found_job_id, CASE WHEN job_id IS NULL THEN 400 WHEN NOT has THEN 404 ELSE 200 END AS code FROM a",
    "qa_requests": f"WITH {QUESTIONS} SELECT question_id, job_id, code, CASE WHEN code = 200 THEN md5({PROMPT}) END AS prompt_md5 FROM a",
    "transcribe_batch": f"""SELECT doc_id AS job_id, CAST(doc_id % 5 AS INTEGER) AS chunk_idx, CASE WHEN strlen(text) % 10 <> 0 THEN md5(text) END AS text, {ECHO('strlen(text)')} FROM documents""",
    "answer_batch": f"""WITH {QUESTIONS}, p AS (SELECT question_id, {PROMPT} AS prompt FROM a WHERE code = 200)
        SELECT question_id, CASE WHEN strlen(prompt) % 10 <> 0 THEN md5(prompt) END AS text, {ECHO('strlen(prompt)')} FROM p""",
    "transcription_run": f"""WITH c AS (SELECT substr(sha256('https://youtu.be/' || conv_id), 1, 16) AS job_id, 'https://youtu.be/' || conv_id AS source_url, turn, md5(text) AS text, strlen(text) AS n FROM conversations),
        g AS (SELECT job_id, any_value(source_url) AS source_url, CAST(count(*) AS INTEGER) AS total_chunks, count(*) FILTER (n % 10 <> 0) AS completed_chunks,
            CAST(max(turn) FILTER (n % 10 <> 0) AS INTEGER) AS last_completed_chunk, CAST(min(turn) FILTER (n % 10 = 0) AS INTEGER) AS next_resume_chunk,
            arg_min(CASE WHEN n % 20 = 0 THEN 'HTTP 503' ELSE 'invalid input' END, turn) FILTER (n % 10 = 0) AS error,
            arg_min(CASE WHEN n % 3 = 0 THEN 'HTTP 429' WHEN n % 20 = 0 THEN 'HTTP 503' ELSE 'invalid input' END, turn) FILTER (n % 10 = 0 OR n % 3 = 0) AS earlier,
            coalesce(string_agg('## Chunk ' || (turn + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (n % 10 <> 0), '') AS transcript FROM c GROUP BY job_id)
        SELECT job_id, source_url, 'youtube' AS platform, CASE WHEN next_resume_chunk IS NULL THEN 'complete' ELSE 'failed' END AS status, total_chunks, completed_chunks, last_completed_chunk, next_resume_chunk,
            coalesce(error, earlier, '') AS error, transcript FROM g""",
    "stream_checkpoints": f"""WITH p AS (SELECT user_id AS job_id, event_type AS key, CASE WHEN {K} % 10 <> 0 THEN CAST({K} AS VARCHAR) END AS value, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
        SELECT job_id, key, value, seq FROM p WHERE n = 1""",
    "stream_streaks": f"WITH {USERS.replace('u AS', 'uu AS')}, {RELAPSES}, u AS (SELECT * FROM uu WHERE user_id IN (SELECT user_id FROM rel)), {streaks_of()}, {STATS}",
    "stream_progress": f"""WITH c AS (SELECT conv_id AS job_id, CAST(turn AS INTEGER) AS chunk_idx, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE {trim('text')} END AS text FROM conversations)
        SELECT job_id, max(chunk_idx) + 1 AS total_chunks, count(*) FILTER (text <> '') AS completed, max(chunk_idx) FILTER (text <> '') AS last_completed, min(chunk_idx) FILTER (text = '') AS next_incomplete,
            coalesce(string_agg('## Chunk ' || (chunk_idx + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (text <> ''), '') AS transcript FROM c GROUP BY job_id""",
    "read_json_objects": """WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1)
        SELECT CAST(conv_id AS VARCHAR) AS job_id, CASE WHEN conv_id % 5 <> 0 AND conv_id % 7 <> 0 THEN turns END AS turns,
            CASE WHEN conv_id % 5 <> 0 AND conv_id % 7 <> 0 THEN 'title ' || conv_id END AS title FROM c""",
    "read_texts": "SELECT CAST(conv_id AS VARCHAR) AS job_id, CASE WHEN conv_id % 5 <> 0 THEN text || chr(10) ELSE '' END AS text FROM conversations WHERE turn = 0",
    "list_chunk_files": "SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(turn AS INTEGER) AS chunk_idx, strlen(text) + 1 AS bytes, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first FROM conversations",
    "read_chunk_results": "SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(turn AS INTEGER) AS chunk_idx, text || chr(10) AS text FROM conversations",
    "read_events": f"WITH {LOG} SELECT CASE WHEN seq % 97 <> 0 THEN CAST(job_id AS VARCHAR) END AS job_id, CASE WHEN seq % 97 <> 0 THEN seq END AS seq, CASE WHEN seq % 97 <> 0 THEN type END AS type, CASE WHEN seq % 97 <> 0 THEN step END AS step, CASE WHEN seq % 97 <> 0 THEN message END AS message, CASE WHEN seq % 97 <> 0 THEN progress END AS progress FROM lg",
    "write_events": f"WITH {LOG} SELECT CAST(job_id AS VARCHAR) AS job_id, seq, type, step, message, progress FROM lg WHERE seq % 97 <> 0",
    "write_transcripts": f"""WITH c AS (SELECT conv_id AS job_id, turn AS chunk_idx, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE {trim('text')} END AS text FROM conversations),
        x AS (SELECT job_id, coalesce(string_agg('## Chunk ' || (chunk_idx + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (text <> ''), '') AS t FROM c GROUP BY job_id)
        SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'new' || chr(10) WHEN t = '' THEN '' ELSE t || chr(10) END AS transcript FROM x""",
    "write_json_objects": f"SELECT {Q_JOB} AS job_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS title, '' AS source_url, '2024-02-01T00:00:00.000Z' AS \"updatedAt\" FROM documents",
}
ORACLE["upsert_checkpoints"] = ORACLE["stream_checkpoints"]
ORACLE["upsert_transcripts"] = ORACLE["write_transcripts"]
ORACLE["word_progress"] = ORACLE["chunk_progress"]
ORACLE["stream_chunk_words"] = f"""WITH {TOTALS}, {PLAN}, done AS (SELECT DISTINCT l_orderkey AS job_id, l_linenumber - 1 AS chunk_idx FROM lineitem WHERE l_linestatus = 'F')
        SELECT job_id, any_value(p.total_chunks) AS total_chunks, count(d.chunk_idx) AS completed, CAST(max(d.chunk_idx) AS INTEGER) AS last_completed, min(CASE WHEN d.chunk_idx IS NULL THEN p.chunk_idx END) AS next_incomplete
        FROM plan p LEFT JOIN done d USING (job_id, chunk_idx) GROUP BY job_id"""
