"""Document metadata, annotations, attachments, images, form fields, layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer")


def edit_metadata(meta: DataFrame, patch: DataFrame, skip_blank: bool = True) -> DataFrame:
    """Overwrite fields by a patch table (doc_id plus any of the text fields)."""
    fields = [c for c in patch.columns if c != "doc_id"]
    p = patch.select("doc_id", *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = meta.join(p, "doc_id", "left")
    for c in fields:
        new = F.col(f"_p_{c}")
        if skip_blank:
            new = F.when(F.trim(new) != "", new)
        joined = joined.withColumn(c, F.coalesce(new, F.col(c)))
    return joined.drop(*[f"_p_{c}" for c in fields])


def keyword_list(keywords: Column) -> Column:
    return F.filter(F.transform(F.split(keywords, ","), lambda k: F.trim(k)), lambda k: k != "")


def remove_metadata(meta: DataFrame, fields: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """Blank the chosen fields and list those that had a value; dates stay."""
    chosen = [f for f in TEXT_FIELDS if f in fields]
    removed = F.array_compact(
        F.array(*[F.when(F.col(f) != "", F.lit(f)) for f in chosen])
    )
    return meta.withColumn("removed_fields", removed).withColumns(
        {f: F.when(F.col(f) != "", F.lit("")).otherwise(F.col(f)) for f in chosen}
    )


# Sanitising steps in the order they are reported.
SANITIZE_STEPS = (
    ("flatten_forms", "forms"),
    ("remove_metadata", "metadata"),
    ("remove_annotations", "annotations"),
    ("remove_javascript", "JavaScript"),
    ("remove_attachments", "embedded files"),
    ("remove_links", "links"),
)


def sanitize(tables: dict[str, DataFrame], flags: Sequence[str]) -> dict[str, DataFrame]:
    """Apply the chosen steps to a set of tables.

    Known tables: meta, annotations (with ``kind``), attachments, actions,
    form_fields.  ``removed`` reports (doc_id, removed_items) in step order.
    """
    on = set(flags)
    out = dict(tables)
    if "flatten_forms" in on and "form_fields" in out:
        out["form_fields"] = out["form_fields"].filter(F.lit(False))
    if "remove_metadata" in on and "meta" in out:
        out["meta"] = remove_metadata(out["meta"]).drop("removed_fields")
    if "annotations" in out:
        if "remove_annotations" in on:
            out["annotations"] = out["annotations"].filter(F.lit(False))
        elif "remove_links" in on:
            out["annotations"] = out["annotations"].filter("kind <> 'Link'")
    if "remove_javascript" in on and "actions" in out:
        out["actions"] = out["actions"].filter("kind <> 'JavaScript'")
    if "remove_attachments" in on and "attachments" in out:
        out["attachments"] = out["attachments"].filter(F.lit(False))
    labels = [label for flag, label in SANITIZE_STEPS if flag in on]
    out["removed"] = tables["meta"].select(
        "doc_id", F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias("removed_items")
    )
    return out


def remove_annotations(
    ann: DataFrame, kinds: Sequence[str] = (), spec: str | None = None
) -> DataFrame:
    """Drop annotations of the given kinds (all when empty) on the given pages."""
    from quirework.functions.pagespec import literal_covers

    hit = F.col("kind").isin(*kinds) if kinds else F.lit(True)
    if spec:
        hit = hit & literal_covers(spec, F.col("page_no"))
    return ann.filter(~hit)


def filter_images(img: DataFrame, min_w: int = 50, min_h: int = 50, min_size: int = 10240) -> DataFrame:
    return img.filter((F.col("width") >= min_w) & (F.col("height") >= min_h) & (F.col("size") >= min_size))


def drop_attachments(att: DataFrame, drop: DataFrame) -> DataFrame:
    """Remove (doc_id, idx) rows."""
    return att.join(drop, ["doc_id", "idx"], "left_anti")


def dedupe_names(att: DataFrame) -> DataFrame:
    """Final, unique attachment names: document stem, page, then the name.

    The first of equal final names (by doc_id, idx) keeps it; the others get
    ``_1``, ``_2``, ... before the extension, leaving out every number whose name
    some attachment bears already.  Names are numbered inside blocks of ever
    narrower id ranges, dense or hashed, so one very common name spreads.
    """
    from quirework.functions.names import stem
    from quirework.operators.prefix import page_block, running
    from quirework.session import materialise

    full = F.concat(
        stem(F.col("filename")),
        F.when(F.col("page_no") > 0, F.concat(F.lit("_page"), F.col("page_no").cast("string"))).otherwise(""),
        F.lit("_"),
        F.col("name"),
    )
    ident = F.col("doc_id").cast("long")
    named = running(
        att.withColumns({"_full": full, "_dot": F.col("name").contains(".")}),
        ["_full"],
        [F.shiftright(ident, 44), F.shiftright(ident, 22), F.col("doc_id"), page_block("idx")],
        ["doc_id", "idx"],
        before="_k",
    )
    # three readers follow
    named = materialise(named, "names")
    # numbers taken: names that read like a numbered copy of another one
    numbered = named.filter("_k = 0").select(
        F.explode(
            F.array(
                F.struct(
                    F.lit(True).alias("_dot"),
                    F.regexp_replace("_full", r"_[1-9]\d{0,14}(\.[^.]*)$", "$1").alias("_base"),
                    F.regexp_extract("_full", r"_([1-9]\d{0,14})\.[^.]*$", 1).alias("_n"),
                ),
                F.struct(
                    F.lit(False).alias("_dot"),
                    F.regexp_replace("_full", r"_[1-9]\d{0,14}$", "").alias("_base"),
                    F.regexp_extract("_full", r"_([1-9]\d{0,14})$", 1).alias("_n"),
                ),
            )
        ).alias("t")
    )
    taken = numbered.filter("t._n <> ''").select(
        F.col("t._base").alias("_full"), F.col("t._dot").alias("_dot"), F.col("t._n").cast("long").alias("_n")
    )
    key = ["_full", "_dot"]
    taken = running(taken, key, [F.shiftright("_n", 32), F.shiftright("_n", 16)], ["_n"], before="_i")
    # free numbers below the i-th taken one; copy k gets the k-th free number: k plus the taken ones below it
    free_below = taken.groupBy(*key, (F.col("_n") - F.col("_i") - 1).alias("_at")).agg(F.count("*").alias("_v"))
    copies = named.filter("_k > 0").select(*key, F.col("_k").alias("_at"), F.lit(0).cast("long").alias("_v"))
    shifted = running(
        copies.unionByName(free_below),
        key,
        [F.shiftright("_at", 32), F.shiftright("_at", 16)],
        ["_at", "_v"],
        F.col("_v"),
        before="_skip",
    )
    shifts = shifted.filter("_v = 0 AND _skip > 0").select(*key, F.col("_at").alias("_k"), "_skip")
    number = (F.col("_k") + F.coalesce("_skip", F.lit(0))).cast("string")
    again = F.when(
        F.col("_dot"),
        F.concat(stem(F.col("_full")), F.lit("_"), number, F.lit("."), F.substring_index("_full", ".", -1)),
    ).otherwise(F.concat(F.col("_full"), F.lit("_"), number))
    return (
        named.join(shifts, [*key, "_k"], "left")
        .withColumn("unique_name", F.when(F.col("_k") == 0, F.col("_full")).otherwise(again))
        .select(*att.columns, "unique_name")
    )


def list_fields(fields: DataFrame) -> DataFrame:
    """Form fields with readable types: ``PDFTextField`` -> ``Text``."""
    kind = F.replace(F.replace(F.col("class_name"), F.lit("PDF"), F.lit("")), F.lit("Field"), F.lit(""))
    return fields.select("doc_id", "name", kind.alias("type"))


# Field kinds that take a value, and what counts as ticked.
FILLABLE = ("Text", "TextField", "CheckBox", "Dropdown", "RadioGroup")
TRUE_TEXT = ("true",)


def fill_forms(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Set field values; the last value per field wins, unknown fields are ignored.

    ``fields``: doc_id, name, type, value; ``values``: doc_id, name, seq, value.
    """
    last = values.groupBy("doc_id", "name").agg(F.max_by("value", "seq").alias("_new"))
    new = F.when(
        F.col("type") == "CheckBox",
        F.when(F.lower("_new").isin(*TRUE_TEXT), "true").otherwise("false"),
    ).otherwise(F.col("_new"))
    use = F.col("_new").isNotNull() & F.col("type").isin(*FILLABLE)
    return (
        fields.join(last, ["doc_id", "name"], "left")
        .withColumn("value", F.when(use, new).otherwise(F.col("value")))
        .drop("_new")
    )


def manage_layers(layers: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply layer actions: toggle, rename, delete, add.

    ``layers``: doc_id, layer_id, name, visible; ``actions``: doc_id, layer_id,
    seq, action, name.  Toggles count, the last rename wins, a delete removes.
    """
    folded = actions.groupBy("doc_id", "layer_id").agg(
        F.count_if(F.col("action") == "toggle").alias("_toggles"),
        F.max_by(
            F.when(F.col("action") == "rename", F.col("name")),
            F.when(F.col("action") == "rename", F.col("seq")),
        ).alias("_name"),
        F.bool_or(F.col("action") == "delete").alias("_gone"),
    )
    old = (
        layers.join(folded, ["doc_id", "layer_id"], "left")
        .filter(~F.coalesce("_gone", F.lit(False)))
        .select(
            "doc_id", "layer_id",
            F.coalesce("_name", "name").alias("name"),
            (F.col("visible") != (F.coalesce("_toggles", F.lit(0)) % 2 == 1)).alias("visible"),
        )
    )
    new = actions.filter("action = 'add'").select(
        "doc_id", "layer_id", "name", F.lit(True).alias("visible")
    )
    return old.unionByName(new)
