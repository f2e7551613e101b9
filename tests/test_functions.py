"""Literal edge cases of the scalar functions and response parsers."""

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import jscompat as JS
from tapeloom.functions import responses as P
from tapeloom.functions import scalars as S


def of(spark, make, *values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_platforms(spark):
    urls = ["not a url", "bilibili.com/x", "https://netflix.com", "http://a_b.com", "HTTPS://WWW.YouTube.COM/x", "https://me:pw@b23.tv:443/1", "https://bilixyz.com", "http://xhslink.com/1", None, "https://vm.tiktok.com/"]
    assert of(spark, S.detect_platform, *urls) == ["generic", "generic", "twitter", "generic", "youtube", "bilibili", "bilibili", "xiaohongshu", "generic", "douyin"]
    assert of(spark, lambda c: S.detect_platform(c, strict=True), "https://netflix.com", "https://x.com/a") == ["generic", "twitter"]
    assert of(spark, S.platform_label, "x", "https://youtu.be/1") == ["web", "youtube"]


def test_job_ids(spark):
    assert of(spark, S.job_id, " https://youtu.be/1\n", "https://youtu.be/1")[0] == of(spark, S.job_id, "https://youtu.be/1")[0]
    assert of(spark, S.is_valid_job_id, "0123456789abcdef", "0123456789ABCDEF", "0123456789abcde", "0123456789abcdeg", None) == [True, True, False, False, False]


@pytest.mark.parametrize(("days", "long", "short"), [(0.949, "23h", "23h"), (0.95, "1d", "23h"), (0.98, "1d", "24h"), (1.44, "1d", "1d"), (1.45, "2d", "1d"), (1.5, "2d", "2d"), (0.0, "0h", "0h")])
def test_labels(spark, days, long, short):
    assert of(spark, S.days_label, days, kind="double") == [long] and of(spark, S.compact_days_label, days, kind="double") == [short]


def test_texts(spark):
    assert of(spark, JS.js_trim, "　 a b \t", "﻿x\n", " ", "\x85y") == ["a b", "x", "", "\x85y"]
    assert of(spark, JS.is_blank, None, " ", "a") == [True, True, False]
    assert of(spark, lambda c: S.limit_text(c, 3), "ab", "abc", "abcd") == ["ab", "abc", "abc\n\n[文稿过长，已截取前 3 个字符用于本次问答]"]
    name = lambda c: S.safe_filename(c, F.lit(None).cast("string"), F.lit("web"))
    assert of(spark, name, 'a\\b/c:d*e?f"g<h>i|j', "a \t b", "", "y" * 130) == ["a_b_c_d_e_f_g_h_i_j-web", "a_b-web", "web", "y" * 120]
    assert of(spark, S.percent_encoded, "a!'()~ é") == ["a!'()~%20%C3%A9.txt"]


def test_numbers(spark):
    raw = ["", "N/A", "NaN", "Infinity", "0", "-1", "12.5", "12.5d", " 12.5 "]
    assert of(spark, S.parse_duration, *raw) == [0.0, None, None, None, 0.0, -1.0, 12.5, None, 12.5]
    assert of(spark, lambda c: S.is_valid_media(S.parse_duration(c)), *raw) == [False] * 6 + [True, False, True]
    assert of(spark, S.is_valid_media, float("nan"), float("inf"), 1.0, None, kind="double") == [False, False, True, False]
    assert of(spark, JS.round_half_up, -2.5, 2.5, kind="double") == [-2, 3]
    assert of(spark, S.clamp_progress, -1.0, None, 101.0, float("nan"), kind="double") == [0.0, 0.0, 100.0, 0.0]
    assert of(spark, lambda c: S.chunk_name(c), 0, 1000, kind="int") == ["chunk-000.txt", "chunk-1000.txt"]
    assert of(spark, lambda c: S.progress_pct(c, F.lit(0)), 3, kind="int") == [0]


def test_errors(spark):
    assert of(spark, S.is_retryable_error, "generated", "code 1500", "fine", None) == [True, True, False, False]
    got = of(spark, lambda c: S.classify_download_error(c, F.lit("https://b23.tv/1")), "HTTP Error 412: x", "an SSLError", "other")
    assert [g.category for g in got] == ["platform_rejected", "ssl", "other"] and got[0].message.endswith("\n原始错误：HTTP Error 412: x") and got[2].message == "other"
    bodies = ['{"code":"c","message":"","request_id":7,"errors":[1,"x"],"error":{"a":1}}', '{"error":"bad"}', "oops", "{}", '{"error":null,"code":0}']
    assert of(spark, lambda c: S.format_api_error(c, F.lit("HTTP 500")), *bodies) == ['code=c; request_id=7; errors=[1,"x"]; error={"a":1}', "error=bad", "HTTP 500", "HTTP 500", "HTTP 500"]


def test_event_streams(spark):
    raw = [
        'data: {"choices":[{"delta":{"content":" a"}}]}\r\n\r\ndata:{"choices":[{"message":{"content":[{"text":"b"},{"x":1},{"text":"c "}]}}]}\ndata: [DONE]\n',
        'data: {"output":{"choices":[{"message":{"content":"q"}}]}}',
        'data: {"choices":[],"output":{"choices":[{"message":{"content":"q"}}]}}',
        "data: {bad\n",
        'event: x\n\ndata:\ndata: {"choices":[{"delta":{"content":5}}]}',
    ]
    got = of(spark, P.extract_sse_text, *raw)
    assert [(g.text, g.parse_error) for g in got] == [("a" + "bc", False), ("q", False), ("", False), (None, True), ("", False)]


def test_chat_bodies(spark):
    raw = ['{"output":{"text":"  "},"choices":[{"message":{"content":" x "}}]}', '{"choices":[{"message":{"content":[{"text":""},{"text":"second"},{"text":"third"}]}}]}', '{"output":{"text":"own","choices":[{"message":{"content":"n"}}]}}', "{}", ""]
    assert of(spark, lambda c: P.route_response(F.lit(""), c)["text"], *raw) == ["x", "second", "own", "", ""]
    assert of(spark, lambda c: P.require_text(P.route_response(F.lit(""), c))["error"], "{}", "{bad", raw[2]) == ["no_text", "bad_response", None]
    assert of(spark, lambda c: P.is_event_stream(F.lit("Text/Event-Stream"), c), "") == [True]


def test_requests_and_titles(spark):
    got = of(spark, lambda c: S.build_chunk_request(c), bytearray(b"x" * 100), kind="binary")[0]
    assert got.encoded_bytes == len("data:video/mp4;base64,") + 136 and not got.over_limit and "\\r" not in got.request
    t = lambda e, u: lambda c: S.resolve_title(F.lit(e).cast("string"), F.lit(u).cast("string"), c)
    assert of(spark, t("old", None), "new\nup") == [("old", "")] and of(spark, t("", "x"), "new\nup", "", "\n") == [("new", "up"), ("Untitled Video", ""), ("Untitled Video", "")]
    assert of(spark, S.validate_submission, " u ", " ", None) == [("u", None), (None, "missing_url"), (None, "missing_url")]
    lines = of(spark, lambda c: S.qa_user_prompt(F.lit(""), F.lit(""), F.lit("text"), c), "why")
    assert lines == ["视频标题：未命名视频\n视频文稿：\ntext\n问题：why"]
