"""Secret scan with corpus-wide ownership frequency.

Candidates are found by regular expressions in every whole text. Their values are hashed, and each hash is counted
over distinct repositories, owners and texts: a value under many owners or in many different texts is a copied example,
one in few texts of a single owner looks live. Long opaque tokens that no base rule covers are reported (kind ``owner``) if
they look like credentials, whatever their verdict.

Positions come from the pieces between the matches: their lengths and those of the matches, summed in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialise

# The base rules in the order in which kinds are listed.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
    r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "owner")
# Kind, pattern, group that holds the value, least length of the value.
RULES = ((0, ASSIGN, 2, 6), (1, ACCESS, 0, 20), (2, HEX, 0, 24), (3, OPAQUE, 0, 20))
COPIED_TEXTS = 20  # different texts from which a value counts as a copied example even under one owner
RAW = "array<struct<kind:int,piece:int,gap:int,size:int,value:string,valued:boolean>>"


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """All matches of one rule with the length of the text before each, back to the match before it."""
    p = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, p, 0).alias("whole"),
        F.regexp_extract_all(text, p, group).alias("value"),
    )
    rows = F.transform(
        F.filter(parts, lambda x: x["whole"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("piece"), F.length(x["before"]).alias("gap"),
            F.length(x["whole"]).alias("size"), x["value"].alias("value"), (F.length(x["value"]) >= least).alias("valued"),
        ),
    )
    return F.when(text.rlike(pattern), rows.cast(RAW)).otherwise(F.array().cast(RAW))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """One written row per document: ``row_id, id, owner, repository, text_key, raw`` (a digest of a text with matches, and all
    matches of all rules)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(f"`{id_col}`").alias("id"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
            F.when(reduce(Column.__or__, [text.rlike(rule[1]) for rule in RULES]), F.md5(text)).alias("text_key"),
            F.concat(*[_found(text, *rule) for rule in RULES]).alias("raw"),
        ),
        "secret-candidates",
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories, owners and texts per value hash.

    Map-side combine reduces the rows of a hash to one per repository before anything is counted, so a value
    copied into a third of all documents costs one row per repository and task; texts are told apart dealt by value and
    text, and their counts combined likewise.
    """
    pairs = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    counts = owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses")
    )
    texts = spans.select("hash", "text_key").distinct().groupBy("hash").agg(F.count("*").alias("texts"))
    return counts.join(texts, "hash")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    copied_owners: int = 3,
    copied_texts: int = COPIED_TEXTS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    ``spans``: row_id, id, kind, start, end (code points, end exclusive), value, owners, repositories, uses,
    texts (different ones; copies of a text count once) and ``verdict``: ``copied_example`` (``copied_owners`` owners or
    ``copied_texts`` texts, or more), ``owner_specific`` (one owner) or ``shared``. Spans of every verdict are listed.
    ``documents``: row_id, id of every row, those without findings too. By default the owner is the ``source`` and a
    repository is a source and language. A null text counts as empty; null owners are one owner of their own; rows
    that repeat an identifier are scanned each for itself; an empty table gives empty results.
    """
    owner = F.col("source") if owner is None else owner
    if repository is None:
        repository = F.concat_ws("/", F.col("source"), F.col("lang"))
    found = candidates(docs, id_col, text_col, owner, repository)
    flat = found.where(F.size("raw") > 0).select("row_id", "id", "owner", "repository", "text_key", F.explode("raw").alias("m")).select(
        "row_id", "id", "owner", "repository", "text_key", "m.*"
    )
    ordered = Window.partitionBy("row_id", "kind").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ordered).cast("bigint"))
        .withColumn("start", F.col("end") - F.col("size"))
        .where("valued")
        .withColumn("hash", F.sha2("value", 256))
    )
    # Opaque tokens count only where they mix letters and digits and no base span overlaps them. Base spans of a row
    # end in order of their start or lie inside an earlier one, so the furthest end so far and the next start decide.
    near = Window.partitionBy("row_id").orderBy("start", "kind")
    base_end = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    base_next = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_next, F.col("end")) >= F.col("end"))
    kept = materialise(
        placed.withColumn("free", free).where((F.col("kind") < 3) | (mixed & F.col("free"))).drop("free", "gap", "size", "piece", "valued"),
        "secret-spans",
    )
    counts = ownership(kept)
    judged = kept.join(counts, "hash")  # a hot hash is split by AQE; the other side has one row for it
    judged = judged.select(
        "row_id", "id", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind"),
        F.col("kind").alias("kind_order"), "start", "end", "value", "owners", "repositories", "uses", "texts",
        F.when((F.col("owners") >= copied_owners) | (F.col("texts") >= copied_texts), "copied_example")
        .when(F.col("owners") == 1, "owner_specific").otherwise("shared").alias("verdict"),
    )
    return found.select("row_id", "id"), judged


def digest(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: counts, all spans as text, the hash of the base spans, and ``verdicts``, all spans with
    their value's owners, texts and verdict."""
    def joined(only_base: bool, *more: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(
            F.col("kind_order") < 3 if only_base else F.lit(True),
            F.struct("start", "kind_order", F.concat_ws(":", "kind", "start", "end", *more).alias("line")),
        )))
        return F.array_join(F.transform(rows, lambda x: x["line"]), ",")

    per = spans.groupBy("row_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(F.col("verdict") == "owner_specific", 1)).alias("n_owner_specific"),
        F.count(F.when(F.col("verdict") == "copied_example", 1)).alias("n_copied_example"),
        joined(True).alias("base"), joined(False).alias("spans"), joined(False, "owners", "texts", "verdict").alias("verdicts"),
    )
    zero = F.lit(0).cast("bigint")
    return documents.join(per, "row_id", "left").select(
        F.col("id").alias("doc_id"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_owner", "n_owner_specific", "n_copied_example")],
        F.coalesce("verdicts", F.lit("")).alias("verdicts"),
    )
