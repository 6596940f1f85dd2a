"""Mail header and body decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENCODED_WORD = r"(?i)=\?([^?]+)\?([BQ])\?([^?]+)\?="


def _bytes_to_text(b: Column, charset: Column) -> Column:
    latin = F.lower(charset).isin("iso-8859-1", "latin-1", "latin1", "us-ascii")
    return F.when(latin, F.decode(b, "ISO-8859-1")).otherwise(F.make_valid_utf8(b.cast("string")))


def _escaped_bytes(s: Column) -> Column:
    """``=C3=A9`` style text as raw bytes."""
    marks = F.regexp_extract_all(s, F.lit(r"(?s)=[0-9A-Fa-f]{2}|[^=]+|="), 0)
    hexed = F.transform(
        marks,
        lambda m: F.when(m.rlike(r"^=[0-9A-Fa-f]{2}$"), F.upper(F.substring(m, 2, 2))).otherwise(
            F.hex(F.encode(m, "UTF-8"))
        ),
    )
    return F.unhex(F.array_join(hexed, ""))


def decode_qp(s: Column, charset: Column | None = None) -> Column:
    """Quoted-printable text: soft breaks removed, bytes decoded."""
    cs = F.lit("utf-8") if charset is None else charset
    return _bytes_to_text(_escaped_bytes(F.regexp_replace(s, "=\r?\n", "")), cs)


def decode_b64(s: Column, charset: Column | None = None) -> Column:
    """Base64 text; undecodable input is returned as it is."""
    cs = F.lit("utf-8") if charset is None else charset
    raw = F.try_to_binary(F.regexp_replace(s, r"\s", ""), F.lit("base64"))
    return F.coalesce(_bytes_to_text(raw, cs), s)


def decode_body(content: Column, encoding: Column, content_type: Column) -> Column:
    """A text body by its transfer encoding and the charset of its content type (UTF-8 where none is named)."""
    charset = F.regexp_extract(content_type, r"(?i)charset=\"?([^\";\s]+)", 1)
    return (
        F.when(encoding.contains("quoted-printable"), decode_qp(content, charset))
        .when(encoding.contains("base64"), decode_b64(content, charset))
        .otherwise(content)
    )


def decode_words(s: Column) -> Column:
    """Header text with ``=?charset?B|Q?...?=`` words decoded."""
    tokens = F.regexp_extract_all(s, F.lit(r"(?is)=\?[^?]+\?[BQ]\?[^?]+\?=|[^=]+|="), 0)

    def one(t: Column) -> Column:
        cs = F.regexp_extract(t, ENCODED_WORD, 1)
        kind = F.upper(F.regexp_extract(t, ENCODED_WORD, 2))
        body = F.regexp_extract(t, ENCODED_WORD, 3)
        return (
            F.when(kind == "B", decode_b64(body, cs))
            .when(kind == "Q", _bytes_to_text(_escaped_bytes(F.replace(body, F.lit("_"), F.lit(" "))), cs))
            .otherwise(t)
        )

    return F.array_join(F.transform(tokens, one), "")
