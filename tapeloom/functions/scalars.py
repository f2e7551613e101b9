"""Scalar functions over URLs, texts, durations and streak lengths: Column to Column, all inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jscompat import JS_WS, first_truthy, host_of, is_blank, js_trim, parse_instant_ms, round_half_up, to_number

#: Platform patterns in the order they are tried.
PLATFORMS = [
    ("bilibili", r"bilibili\.com|b23\.tv|bili[a-z]*\.com"),
    ("youtube", r"youtube\.com|youtu\.be|googlevideo\.com"),
    ("douyin", r"douyin\.com|tiktok\.com"),
    ("xiaohongshu", r"xiaohongshu\.com|xhslink\.com"),
    ("twitter", r"twitter\.com|x\.com"),
]
#: Error patterns.
RETRYABLE = r"(?i)timeout|timed out|socket|network|ECONN|ETIMEDOUT|429|rate|Too Many|500|502|503|504|Bad Gateway|Service Unavailable"
REJECTED = r"(?i)HTTP Error 412|Precondition Failed"
SSL = r"(?i)UNEXPECTED_EOF_WHILE_READING|SSLError|SSL"
AUTH = r"(?i)unauthorized|invalid api[-_ ]?key|401"
#: What users read.
ENCOURAGEMENTS = [
    (2, "First Steps Count", "Your brain is already responding to the decision. Keep the next hour simple and protect your focus."),
    (7, "Momentum Is Building", "You may notice clearer energy and a little more control over urges. Small choices are starting to stack up."),
    (14, "One Week Strong!", "A full week is a major milestone. Your brain is beginning to heal. You might notice improved focus and energy. This is just the beginning."),
    (None, "Deeper Reset", "Your discipline is becoming part of your identity. Expect steadier confidence, better attention, and more space between urges and action."),
]
#: Rank percents by score.
RANKS = [(90, 10), (60, 25), (34, 40), (16, 55), (None, 72)]
#: Advice on download errors.
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
#: Stand-ins for titles, limits, the prompt.
UNTITLED_VIDEO, UNTITLED_QUESTION = "Untitled Video", "未命名视频"
QUESTION_LIMIT, PREVIEW_LIMIT, FILE_NAME_LIMIT = 90_000, 2_000, 120
SYSTEM_PROMPT = "你是一个视频文稿问答助手。只基于用户提供的视频文稿回答问题；如果文稿里没有依据，请明确说文稿中没有相关信息。回答要直接、清楚，必要时引用文稿中的关键句，但不要编造时间戳。"
REQUEST_LIMIT_BYTES = 28 * 1024 * 1024


def detect_platform(url: Column, strict: bool = False) -> Column:
    """The platform of a URL by its host. Patterns are unanchored (a host that ends in x.com is "twitter"); strict anchors them."""
    host, out = host_of(url), None
    for name, pattern in PLATFORMS:
        found = host.rlike(f"(^|\\.)({pattern})$" if strict else pattern)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("generic")


def platform_label(url: Column) -> Column:
    """detect_platform with "web" for what is not a known platform."""
    p = detect_platform(url)
    return F.when(p == "generic", "web").otherwise(p)


def job_id(url: Column) -> Column:
    """The first 16 hex digits of the trimmed URL's SHA-256."""
    return F.substring(F.sha2(js_trim(url), 256), 1, 16)


def is_valid_job_id(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[a-f0-9]{16}$"), F.lit(False))


def parse_instant(text: Column) -> Column:
    """Milliseconds of an ISO-8601 instant, null if invalid."""
    return parse_instant_ms(text)


def round_days(days: Column) -> Column:
    return F.floor(days * 10 + 0.5) / 10


def days_label(days: Column) -> Column:
    """Hours if the rounded days are under 1, else the rounded days rounded again."""
    r = round_days(days)
    return F.when(r < 1, F.concat(F.greatest(F.lit(0), round_half_up(days * 24)).cast("string"), F.lit("h"))).otherwise(F.concat(round_half_up(r).cast("string"), F.lit("d")))


def compact_days_label(days: Column) -> Column:
    """Hours if the days themselves are under 1, else the days rounded once."""
    return F.when(days < 1, F.concat(F.greatest(F.lit(0), round_half_up(days * 24)).cast("string"), F.lit("h"))).otherwise(F.concat(round_half_up(days).cast("string"), F.lit("d")))


def _steps(value: Column, steps: list[tuple], at_least: bool, make) -> Column:
    out = None
    for bound, *rest in steps[:-1]:
        test = value >= bound if at_least else value < bound
        out = F.when(test, make(*rest)) if out is None else out.when(test, make(*rest))
    return out.otherwise(make(*steps[-1][1:]))


def streak_score(current: Column, best: Column, relapses: Column) -> Column:
    return current * 6 + best * 4 - relapses * 5


def rank_percent(current: Column, best: Column, relapses: Column) -> Column:
    return _steps(streak_score(current, best, relapses), RANKS, True, F.lit)


def encouragement(days: Column) -> Column:
    """A struct (title, body) by the rounded days."""
    return _steps(round_days(days), ENCOURAGEMENTS, False, lambda t, b: F.struct(F.lit(t).alias("title"), F.lit(b).alias("body")))


def karma(current: Column, best: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), round_half_up(current + best / 2))


def limit_text(text: Column, n: int = QUESTION_LIMIT) -> Column:
    """The first n characters (code points) and a note, if the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(f"\n\n[文稿过长，已截取前 {n} 个字符用于本次问答]"))).otherwise(text)


def safe_filename(title: Column, uploader: Column, platform: Column) -> Column:
    """title-uploader-platform without empty parts, forbidden characters or white space, of at most 120 characters."""
    raw = F.concat_ws("-", *(F.nullif(c, F.lit("")) for c in (title, uploader, platform)))
    # each run of white space and each other character gives one of the name, so no more of them than it may have are looked at
    head = F.regexp_extract(raw, f"(?s)^(?:{JS_WS}++|[^{JS_WS[1:]}){{0,{FILE_NAME_LIMIT}}}", 0)
    return F.substring(F.regexp_replace(F.regexp_replace(head, r'[\\/:*?"<>|]', "_"), f"{JS_WS}+", "_"), 1, FILE_NAME_LIMIT)


def percent_encoded(name: Column) -> Column:
    """The name as a header's file name carries it, with .txt."""
    out = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.concat(out, F.lit(".txt"))


def transcript_preview(text: Column) -> Column:
    return F.substring(js_trim(text), 1, PREVIEW_LIMIT)


def progress_pct(done: Column, total: Column) -> Column:
    """Whole percent; 0 without a total."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(round_half_up(done * 100.0 / F.nullif(total, F.lit(0))))


def clamp_progress(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))))


def chunk_progress_pct(index: Column, total: Column, saved: bool) -> Column:
    """The percent an event reports: chunks before this one when it starts, this one too when it is saved or resumed."""
    return progress_pct(index + 1 if saved else index, total)


def is_retryable_error(message: Column) -> Column:
    return F.coalesce(message.rlike(RETRYABLE), F.lit(False))


def is_auth_error(detail: Column) -> Column:
    return F.coalesce(detail.rlike(AUTH), F.lit(False))


def download_error_category(message: Column, url: Column) -> Column:
    return F.when((detect_platform(url) == "bilibili") & message.rlike(REJECTED), "platform_rejected").when(message.rlike(SSL), "ssl").otherwise("other")


def classify_download_error(message: Column, url: Column) -> Column:
    """A struct (category, message): advice lines and the original error last; other errors as they are."""
    category = download_error_category(message, url)
    return F.struct(category.alias("category"), download_error_message(category, message).alias("message"))


def download_error_message(category: Column, message: Column) -> Column:
    told = lambda lines: F.concat(F.lit("\n".join([*lines, ORIGINAL_ERROR])), message)
    return F.when(category == "platform_rejected", told(REJECTED_LINES)).when(category == "ssl", told(SSL_LINES)).otherwise(message)


def format_api_error(body: Column, fallback: Column) -> Column:
    """code, message and request ids that are there, then errors and error, joined by "; "; else the fallback.

    ``body`` is the response as JSON text; what is no JSON object has no parts.
    """
    v = F.try_parse_json(body)
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    kind = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    truthy = lambda key: F.when(text(key).isin("", "0", "false"), None).otherwise(text(key))
    raw = lambda key: F.to_json(F.try_variant_get(v, f"$.{key}", "variant"))
    parts = [F.concat(F.lit(f"{k}="), truthy(k)) for k in ("code", "message", "request_id", "requestId")]
    parts.append(F.when(kind("errors").startswith("ARRAY"), F.concat(F.lit("errors="), raw("errors"))))
    error = F.when(kind("error") == "STRING", truthy("error")).when(raw("error").isin("null", "false", "0"), None).otherwise(raw("error"))
    parts.append(F.concat(F.lit("error="), error))
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), fallback)


def qa_user_prompt(title: Column, url: Column, transcript: Column, question: Column) -> Column:
    lines = [F.concat(F.lit("视频标题："), first_truthy(title, F.lit(UNTITLED_QUESTION))), F.concat(F.lit("来源链接："), F.nullif(url, F.lit(""))), F.lit("视频文稿："), F.nullif(limit_text(transcript), F.lit("")), F.concat(F.lit("问题："), question)]
    return F.concat_ws("\n", *lines)


def build_qa_prompt(title: Column, url: Column, transcript: Column, question: Column, model: str = "chat") -> Column:
    """The chat request as JSON text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", qa_user_prompt(title, url, transcript, question))).alias("messages"), F.lit(True).alias("stream")))


def build_chunk_request(content: Column, prompt: str = "", model: str = "asr") -> Column:
    """A struct (request, encoded_bytes, over_limit) for one media chunk as a data URL."""
    url = F.concat(F.lit("data:video/mp4;base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))
    parts = F.array(F.struct(F.lit("video_url").alias("type"), F.struct(url.alias("url")).alias("video_url"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("struct<url:string>").alias("video_url"), F.lit(prompt).alias("text")))
    request = F.to_json(F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("messages"), F.lit(True).alias("stream")))
    size = F.length(url).cast("long")
    return F.struct(request.alias("request"), size.alias("encoded_bytes"), (size > REQUEST_LIMIT_BYTES).alias("over_limit"))


def parse_duration(text: Column) -> Column:
    """Seconds as a double; blank is 0, what is no finite number is null."""
    return to_number(text)


def is_valid_media(duration: Column) -> Column:
    return F.coalesce(~F.isnan(duration) & (duration > 0) & (duration < float("inf")), F.lit(False))


def chunk_name(index: Column, extension: str = "txt") -> Column:
    return F.concat(F.lit("chunk-"), F.format_string("%03d", index), F.lit(f".{extension}"))


def resolve_title(existing_title: Column, existing_uploader: Column, fetched: Column) -> Column:
    """A struct (title, uploader): what is stored, else lines 1 and 2 of the fetched text."""
    lines = F.split(js_trim(F.coalesce(fetched, F.lit(""))), "\n")
    line = lambda k: F.try_element_at(lines, F.lit(k))
    stored = F.nullif(existing_title, F.lit(""))
    return F.struct(
        F.coalesce(stored, first_truthy(line(1)), F.lit(UNTITLED_VIDEO)).alias("title"),
        F.when(stored.isNotNull(), F.coalesce(existing_uploader, F.lit(""))).otherwise(F.coalesce(first_truthy(line(2)), F.lit(""))).alias("uploader"),
    )


def validate_submission(url: Column) -> Column:
    """A struct (url, reason): the trimmed URL, or why it is rejected."""
    t = js_trim(F.coalesce(url, F.lit("")))
    return F.struct(F.nullif(t, F.lit("")).alias("url"), F.when(t == "", "missing_url").alias("reason"))


def job_summary_label(next_resume: Column, total: Column, completed: Column, current: Column) -> Column:
    """What is next for a job, by human (one-based) chunk numbers."""
    return (
        F.when(next_resume.isNotNull(), F.concat(F.lit("resume "), next_resume.cast("string")))
        .when((F.coalesce(total, F.lit(0)) > 0) & (completed >= total), "done")
        .when(current.isNotNull(), F.concat(F.lit("running "), current.cast("string")))
        .otherwise("not started")
    )


def downloadable(completed: Column, total: Column) -> Column:
    return (completed > 0) & (completed >= F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F", "is_blank")]
