"""Internet mail messages to header columns and part rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.arrays import exploded, let
from quirework.functions.mail import decode_body, decode_words
from quirework.functions.text import strip


def _header_lines(head: Column) -> Column:
    """array<struct<key,value>> with folded lines joined; a key may repeat."""
    flat = F.regexp_replace(head, r"[ \t]*\n[ \t]+", " ")
    lines = F.filter(F.split(flat, "\n"), lambda l: F.position(F.lit(":"), l) > 1)
    return F.transform(
        lines,
        lambda l: F.struct(
            F.lower(strip(F.substring_index(l, ":", 1))).alias("key"),
            strip(F.substring(l, F.position(F.lit(":"), l) + 1, F.length(l))).alias("value"),
        ),
    )


def _header(headers: Column, key: str) -> Column:
    """Last header of that name, null when absent."""
    found = F.filter(headers, lambda h: h["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def _cut(text: Column) -> tuple[Column, Column]:
    """(head, body) around the first blank line."""
    at = F.position(F.lit("\n\n"), text)
    head = F.when(text.startswith("\n"), F.lit("")).when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    body = (
        F.when(text.startswith("\n"), F.substring(text, F.lit(2), F.length(text)))
        .when(at > 0, F.substring(text, at + 2, F.length(text)))
        .otherwise(F.lit(""))
    )
    return head, body


def _with_headers(raw: DataFrame) -> DataFrame:
    text = F.replace(F.col("raw"), F.lit("\r\n"), F.lit("\n"))
    head, body = _cut(F.col("_t"))
    df = raw.withColumn("_t", text).select("doc_id", head.alias("_head"), body.alias("_body"))
    df = df.select("doc_id", "_body", _header_lines(F.col("_head")).alias("_h"))
    ctype = F.coalesce(_header(F.col("_h"), "content-type"), F.lit("text/plain"))
    encoding = F.lower(F.coalesce(_header(F.col("_h"), "content-transfer-encoding"), F.lit("")))
    return df.withColumns({"_ct": ctype, "_enc": encoding})


_STATE = (
    "struct<stack:array<struct<b:string,path:string,n:int,fwd:boolean>>,cur:struct<path:string,at:int,fwd:boolean>,"
    "done:array<struct<path:string,at:int,upto:int,fwd:boolean>>>"
)


def _boundary(content_type: Column) -> Column:
    return F.regexp_extract(content_type, r"(?i)boundary=\"?([^\";\s]+)\"?", 1)


def _behind_first(a: Column) -> Column:
    return F.slice(a, 2, F.size(a))


def _segments(body: Column, declared: Column) -> Column:
    """Text behind each delimiter line of any declared boundary: i, name (behind the dashes), content, head and body of the part, its type and,
    where it holds parts, their boundary; ``msg`` marks an enclosed message."""
    quoted = F.transform(declared, lambda b: F.regexp_replace(b, r"([^A-Za-z0-9_])", r"\\$1"))
    line = F.concat(F.lit("(?m)^--(?:"), F.array_join(quoted, "|"), F.lit(r")(?:--)?[ \t]*$"))
    cut = F.transform(
        F.arrays_zip(F.regexp_extract_all(body, line, F.lit(0)).alias("mark"), _behind_first(F.split(body, line, -1)).alias("text")),
        # a part begins on the line behind its delimiter
        lambda p: F.struct(F.regexp_replace(F.substring(p["mark"], F.lit(3), F.length(p["mark"])), r"[ \t]+$", "").alias("name"), F.regexp_replace(p["text"], r"^\n", "").alias("content")),
    )

    def with_head(p: Column, i: Column) -> Column:
        head, rest = _cut(p["content"])
        return F.struct(i.cast("int").alias("i"), p["name"].alias("name"), p["content"].alias("content"), _header_lines(head).alias("h"), rest.alias("body"))

    def with_type(p: Column) -> Column:
        return F.struct(*[p[c].alias(c) for c in ("i", "name", "content", "h", "body")], F.coalesce(_header(p["h"], "content-type"), F.lit("text/plain")).alias("ctype"))

    def with_box(p: Column) -> Column:
        msg = F.lower(p["ctype"]).contains("message/rfc822")
        box = F.when(~msg, p["ctype"]).otherwise(_header(_header_lines(_cut(p["body"])[0]), "content-type"))
        box = let(box, lambda b: F.when(F.lower(b).contains("multipart"), _boundary(b)).otherwise(F.lit("")))
        return F.struct(*[p[c].alias(c) for c in ("i", "name", "content", "h", "body", "ctype")], msg.alias("msg"), F.coalesce(box, F.lit("")).alias("box"))

    return F.transform(F.transform(F.transform(cut, with_head), with_type), with_box)


def _resolve(segments: Column, outer: Column) -> Column:
    """Parts as (path, at, upto, fwd): delimiters are brackets, opened and closed in one ordered fold over the segments.

    A delimiter of an outer boundary closes what is open inside; one that is not open is content.  ``fwd`` marks parts of an enclosed message."""
    none = F.lit(None).cast("struct<path:string,at:int,fwd:boolean>")
    top = F.array(F.struct(outer.alias("b"), F.lit("").alias("path"), F.lit(0).alias("n"), F.lit(False).alias("fwd")))
    start = F.struct(top.alias("stack"), none.alias("cur"), F.lit(None).alias("done")).cast(_STATE)
    start = F.struct(start["stack"].alias("stack"), start["cur"].alias("cur"), F.array().cast("array<struct<path:string,at:int,upto:int,fwd:boolean>>").alias("done")).cast(_STATE)

    def close(acc: Column, last: Column) -> Column:
        c = acc["cur"]
        more = F.array(F.struct(c["path"].alias("path"), c["at"].alias("at"), last.alias("upto"), c["fwd"].alias("fwd")))
        return F.when(c.isNull(), acc["done"]).otherwise(F.concat(acc["done"], more))

    def bracket(acc: Column, s: Column) -> Column:
        """Which open boundary a delimiter belongs to (0: none), and whether it closes it."""

        def found(names: Column) -> Column:
            short = F.regexp_replace(s["name"], "--$", "")
            ends = ~F.array_contains(names, s["name"]) & F.array_contains(names, short)
            # the innermost of that name
            at = F.array_position(F.reverse(names), F.when(ends, short).otherwise(s["name"]))
            return F.struct(ends.alias("ends"), F.when(at > 0, F.size(names) - at + 1).otherwise(0).cast("int").alias("depth"))

        return let(F.transform(acc["stack"], lambda x: x["b"]), found)

    def step(acc: Column, s: Column) -> Column:
        def moved(m: Column) -> Column:
            below = F.slice(acc["stack"], 1, F.greatest(m["depth"] - 1, F.lit(0)))

            def opened(own: Column) -> Column:
                path = F.concat_ws(".", F.when(own["path"] != "", own["path"]), (own["n"] + 1).cast("string"))
                counted = F.struct(own["b"].alias("b"), own["path"].alias("path"), (own["n"] + 1).alias("n"), own["fwd"].alias("fwd"))
                inside = F.struct(s["box"].alias("b"), path.alias("path"), F.lit(0).alias("n"), (own["fwd"] | s["msg"]).alias("fwd"))
                stack = F.concat(below, F.when(s["box"] != "", F.array(counted, inside)).otherwise(F.array(counted)))
                part = F.struct(path.alias("path"), s["i"].alias("at"), own["fwd"].alias("fwd"))
                return F.struct(stack.alias("stack"), F.when((s["box"] == "") | s["msg"], part).alias("cur"), close(acc, s["i"] - 1).alias("done")).cast(_STATE)

            closed = F.struct(below.alias("stack"), none.alias("cur"), close(acc, s["i"] - 1).alias("done")).cast(_STATE)
            return F.when(m["depth"] == 0, acc).when(m["ends"], closed).otherwise(let(F.get(acc["stack"], m["depth"] - 1), opened))

        return let(bracket(acc, s), moved)

    return F.aggregate(segments, start, step, lambda acc: close(acc, F.size(segments) - 1))


def _parts(df: DataFrame) -> DataFrame:
    """Adds ``_parts``, the array of parts of each message; null where it is not of several parts."""
    multi = F.lower("_ct").contains("multipart") & (_boundary(F.col("_ct")) != "")
    # boundaries that no header declares are text; those that a text happens to name are sorted out by the fold
    declared = F.array_distinct(F.concat(F.array(_boundary(F.col("_ct"))), F.regexp_extract_all("_body", F.lit(r"(?i)boundary=\"?([^\";\s]+)\"?"), F.lit(1))))
    df = df.withColumn("_s", F.when(multi, _segments(F.col("_body"), declared)))
    df = df.withColumn("_p", F.when(multi, _resolve(F.col("_s"), _boundary(F.col("_ct")))))

    def lines(s: Column) -> Column:
        return F.concat(F.lit("--"), s["name"], F.lit("\n"), s["content"])

    def part(p: Column, i: Column) -> Column:
        inside = F.filter(F.col("_p"), lambda x: F.startswith(x["path"], F.concat(p["path"], F.lit("."))))
        upto = F.greatest(p["upto"], F.array_max(F.transform(inside, lambda x: x["upto"])))

        def built(s: Column) -> Column:
            more = F.array_join(F.transform(F.slice(F.col("_s"), p["at"] + 2, F.when(s["msg"], upto).otherwise(p["upto"]) - p["at"]), lines), "")
            end = F.when(s["msg"] & (s["box"] != ""), F.concat(F.lit("--"), s["box"], F.lit("--\n"))).otherwise("")
            return F.struct(
                (i + 1).cast("long").alias("part_no"), p["path"].alias("path"), p["fwd"].alias("forwarded"), s["ctype"].alias("content_type"),
                F.lower(F.coalesce(_header(s["h"], "content-transfer-encoding"), F.lit(""))).alias("encoding"),
                _header(s["h"], "content-disposition").alias("disposition"),
                F.regexp_replace(_header(s["h"], "content-id"), "[<>]", "").alias("content_id"),
                F.concat(s["body"], more, end).alias("content"), s["msg"].alias("msg"),
            )

        return let(F.element_at("_s", p["at"] + 1), built)

    def described(p: Column) -> Column:
        ct, disp, cid = p["content_type"], F.coalesce(p["disposition"], F.lit("")), F.coalesce(p["content_id"], F.lit(""))
        put_aside = F.lower(disp).startswith("attachment")
        name_d = F.regexp_extract(disp, r"(?i)filename=\"?([^\";\s]+)\"?", 1)
        name_c = F.regexp_extract(ct, r"(?i)name=\"?([^\";\s]+)\"?", 1)
        kind = (
            F.when(put_aside | p["msg"], "attachment").when(ct.contains("text/html"), "html").when(ct.contains("text/plain"), "text")
            .when(ct.contains("image/") | (disp != "") | (cid != ""), "attachment").otherwise("other")
        )
        names = ("part_no", "path", "forwarded", "content_type", "encoding", "disposition", "content_id")
        return F.struct(
            *[p[c].alias(c) for c in names], kind.alias("kind"),
            F.when(name_d != "", name_d).when(name_c != "", name_c).otherwise("attachment").alias("filename"),
            (disp.contains("inline") | ((cid != "") & ~disp.contains("attachment"))).alias("is_inline"), p["content"].alias("content"),
        )

    return df.withColumn("_parts", F.transform(F.transform("_p", part), described)).drop("_s", "_p")


def email_parts(raw: DataFrame) -> DataFrame:
    """Parts of multipart messages, in order, without the body texts' decoding.

    (doc_id, part_no, path, forwarded, content_type, encoding, disposition,
    content_id, kind, filename, is_inline, content); kind is html, text,
    attachment or other.  Parts may hold parts: ``path`` is the place in the tree
    (2.1 is the first part of the second one), containers have no row of
    their own, and an enclosed message is an attachment whose parts are
    ``forwarded``.
    """
    return exploded(_parts(_with_headers(raw)), "doc_id", array=F.col("_parts"), value="p").select("doc_id", "p.*")


def parse_emails(raw: DataFrame) -> DataFrame:
    """(doc_id, raw) -> one row per message: headers and last html / text body.

    Bodies are decoded by transfer encoding and charset, in messages of one part
    and of several, at any depth; texts that are attached, and those of an
    enclosed message, are no bodies.  All of it is work within the row.
    """
    df = _parts(_with_headers(raw))
    h = F.col("_h")

    def head(key: str, default: str | None = "") -> Column:
        v = _header(h, key)
        if default is None:
            return F.when(v != "", decode_words(v))
        return decode_words(F.when(v != "", v).otherwise(F.lit(default)))

    def last(kind: str) -> Column:
        return F.try_element_at(F.filter("_parts", lambda p: (p["kind"] == kind) & ~p["forwarded"]), F.lit(-1))

    multi = F.lower("_ct").contains("multipart")
    web = F.col("_ct").contains("text/html")
    single = F.struct(F.col("_body").alias("content"), F.col("_enc").alias("encoding"), F.col("_ct").alias("content_type"))
    pick = lambda p: F.struct(*[p[c].alias(c) for c in ("content", "encoding", "content_type")])
    df = df.withColumns(
        {
            "_mh": F.when(multi, pick(last("html"))).when(web, single),
            "_mt": F.when(multi, pick(last("text"))).when(~web, single),
        }
    )
    body = lambda c: decode_body(F.col(c)["content"], F.col(c)["encoding"], F.col(c)["content_type"])
    return df.select(
        "doc_id",
        head("subject", "(No Subject)").alias("subject"),
        head("from").alias("sender"),
        head("to").alias("recipients"),
        head("cc", None).alias("cc"),
        head("bcc", None).alias("bcc"),
        F.coalesce(
            *[
                F.try_to_timestamp(
                    F.regexp_replace(F.regexp_replace(_header(h, "date"), r"^[A-Za-z]{3},\s*", ""), r"\s*\(.*\)$", ""),
                    F.lit(f),
                )
                for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")
            ]
        ).alias("sent_ts"),
        body("_mh").alias("html_body"),
        body("_mt").alias("text_body"),
        F.coalesce(F.size(F.filter("_parts", lambda p: (p["kind"] == "attachment") & ~p["forwarded"])), F.lit(0)).cast("long").alias("n_attachments"),
    )


def email_attachments(raw: DataFrame) -> DataFrame:
    """Attachment rows; base64 content is kept as text and decoded to bytes."""
    b64 = F.when(F.col("encoding").contains("base64"), F.regexp_replace("content", r"\s", ""))
    return email_parts(raw).filter("kind = 'attachment'").select(
        "doc_id", "part_no", "filename", "content_type", "content_id", "is_inline",
        b64.alias("base64_data"),
        F.try_to_binary(b64, F.lit("base64")).alias("data"),
    )


def resolve_cids(bodies: DataFrame, attachments: DataFrame) -> DataFrame:
    """Replace ``cid:`` references in html_body by data addresses of inline parts.

    The body is cut at its references; each reference is looked up by an
    equi-join on (doc_id, content_id), and pieces are put together in order.
    Unknown references stay as they are.
    """
    ref = r"""(?i)src=["']cid:[^"']+["']|url\(["']?cid:[^"')]+["']?\)"""
    cid = F.regexp_extract("_tok", r"""(?i)cid:([^"')]+)""", 1)
    # each piece is a reference or the text up to the next one
    pieces = F.regexp_extract_all(F.coalesce("html_body", F.lit("")), F.lit(f"(?s){ref}|.+?(?={ref}|$(?!.))"), F.lit(0))
    toks = bodies.select("doc_id", F.posexplode_outer(pieces).alias("_i", "_tok"))
    toks = toks.withColumn("content_id", F.when(F.col("_tok").rlike(f"^(?:{ref})$"), cid))
    known = (
        attachments.filter("is_inline AND content_id <> '' AND base64_data IS NOT NULL")
        .groupBy("doc_id", "content_id")
        .agg(F.max_by(F.struct("content_type", "base64_data"), "part_no").alias("_a"))
    )
    uri = F.concat(F.lit("data:"), F.col("_a.content_type"), F.lit(";base64,"), F.col("_a.base64_data"))
    shown = (
        F.when(F.col("_a").isNull(), F.col("_tok"))
        .when(F.lower("_tok").startswith("src"), F.concat(F.lit('src="'), uri, F.lit('"')))
        .otherwise(F.concat(F.lit('url("'), uri, F.lit('")')))
    )
    return (
        toks.join(known, ["doc_id", "content_id"], "left")
        .withColumn("_s", shown)
        .groupBy("doc_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]), ""
            ).alias("html_body")
        )
    )
