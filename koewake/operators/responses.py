"""Replies of a recogniser, and the merge of two emotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.functions.text import strip_blanks

_ANNOTATION = "array<struct<emotion:string,language:string>>"
_REPLY = f"struct<output:struct<choices:array<struct<message:struct<content:string,annotations:{_ANNOTATION}>>>>>"


def clamp_emotion(x: Column) -> Column:
    """A known emotion, else neutral."""
    return F.when(x.isin(*S.EMOTIONS), x).otherwise("neutral")


def parse(replies: DataFrame, body: str = "body", code: str = "status_code") -> DataFrame:
    """Adds ``ok, text, emotion, language, confidence``.

    The content may be a string or a list of parts; a reply that failed, is no JSON or has no choices gives an empty
    text, neutral, no language and no confidence.
    """
    message = F.get(F.from_json(body, _REPLY)["output"]["choices"], F.lit(0))["message"]
    parts = F.from_json(F.col("_content"), "array<struct<text:string>>")
    listed = F.col("_content").startswith("[")
    text = F.when(listed, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")).otherwise(F.col("_content"))
    rows = replies.withColumn("_message", message).withColumns({"_content": F.ltrim(F.col("_message.content")), "_note": F.get(F.col("_message.annotations"), F.lit(0))})
    ok = F.coalesce((F.col(code) == 200) & F.col("_message").isNotNull(), F.lit(False))
    out = rows.withColumn("ok", ok).withColumns(
        {
            "text": F.when(F.col("ok"), strip_blanks(F.coalesce(text, F.lit("")))).otherwise(""),
            "emotion": F.when(F.col("ok"), clamp_emotion(F.col("_note.emotion"))).otherwise("neutral"),
            "language": F.when(F.col("ok"), F.coalesce(F.col("_note.language"), F.lit(""))).otherwise(""),
            "confidence": F.when(F.col("ok"), F.lit(S.DONE_CONFIDENCE)).otherwise(F.lit(0.0)),
        }
    )
    return out.drop("_message", "_content", "_note")


def outcome(replies: DataFrame, body: str = "body", code: str = "status_code", issues: Column | None = None) -> DataFrame:
    """Parsed replies with ``status, error_msg``: done with a text, else error, and why; ``issues`` of the recording go with it."""
    code = F.col(code)
    failed = F.coalesce(F.get_json_object(F.when(F.try_parse_json(F.col(body)).isNotNull(), F.col(body)), "$.message"), F.concat(F.lit("status "), F.coalesce(code.cast("string"), F.lit("?"))))
    why = F.when(F.col("ok"), "empty transcription").when(code == 200, "no choices in response").otherwise(failed)
    if issues is not None:
        why = F.concat(why, F.when(F.size(issues) > 0, F.concat(F.lit(" | audio: "), F.array_join(issues, "; "))).otherwise(""))
    done = F.col("ok") & (F.col("text") != "")
    return replies.withColumns({"status": F.when(done, "done").otherwise("error"), "error_msg": F.when(~done, why)})


def merge_emotion(audio: Column, text: Column, confidence: Column) -> Column:
    """``struct(source, final, needs_review)``: the audio's emotion always stays, a difference asks for review."""
    t = F.coalesce(text, F.lit(""))
    same = F.lower(t) == F.lower(audio)
    source = F.when(t == "", "audio_only").when(same, "both_agree").otherwise("conflict")
    review = F.when(t == "", False).when(same, F.coalesce(confidence, F.lit(0.0)) < S.SURE_CONFIDENCE).otherwise(True)
    return F.struct(source.alias("source"), audio.alias("final"), review.alias("needs_review"))


def data_uri(content: Column, path: Column) -> Column:
    """A file's bytes as a data URI; unknown types go as wav."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    mime = F.lit("audio/wav")
    for s, m in S.MIME.items():
        mime = F.when(suffix == s, m).otherwise(mime)
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))
