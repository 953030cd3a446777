r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut after sentence ends.  Each distinct paragraph has a 64-bit
digest whose low 20 bits check the others, and adds (1, digest) to one cell in each of the sketch's
three parts: counts are summed, digests xor-ed.  Subtracting the sketches of two versions leaves
the paragraphs of one of them only.  A cell that holds one digest (count 1 or -1, check and place
right) is pure; peeling takes its digest out of the other two cells, which makes others pure.
When all cells are empty the recovered digests are the difference; if cells are left, the pair is
tried again with GROWTH times as many cells, until every pair is done.  The likeness of two
versions is the share of paragraphs that they have in common:
(a + b - difference) / (a + b + difference) for a and b paragraphs, 1 for two versions without any.

A document's edited version has its last third (whole characters) replaced by the start of the next
document's text, in descending order of ids and after the last the first.

Defined cases: a null text is empty; a null id comes after all others; rows with equal ids follow
by their text's hash, and rows equal in id and text are one document that stands in the output as
often as in the input; a single document is its own next; an empty table gives no rows.  Only
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.tables import released

PARAGRAPH = r"\n|(?<=[.!?]) +"
CHECK = (1 << 20) - 1
PART = 8                   # cells in each of the three parts at first: 24 cells
GROWTH = 8
ROUNDS = 15                # peeling rounds, each of one part in turn
MAX_PART = 1 << 40
FIRST_ID = -(2**63)        # stands for a null id: the last in descending order

KEY, NEXT = ["kid", "tid"], ["nkid", "ntid"]


def _checked(h: Column) -> Column:
    top = h.bitwiseAND(F.lit(~CHECK))
    return top.bitwiseOR(F.xxhash64(top).bitwiseAND(F.lit(CHECK)))


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs, none of them 0."""
    parts = F.array_remove(F.split(text, PARAGRAPH), "")
    return F.array_distinct(F.transform(F.transform(parts, lambda p: F.xxhash64(p)), _checked))


def _place(x: Column, part: int, size: int) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(part), F.lit(size)), F.lit(size)) + F.lit(part * size)


def _is_checked(x: Column) -> Column:
    return _checked(x) == x


def _cells(x: Column, size: int) -> Column:
    return F.array(*[_place(x, part, size) for part in range(3)])


def next_documents(ids: DataFrame) -> DataFrame:
    """(kid, tid, n_chars, n, nkid, ntid) of distinct (kid, tid, ...): the next in descending order.

    Sorted by ranges; the windows see one range each, and then one row a range.
    """
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("kid"), F.desc("tid")]
    placed = released(ids.repartitionByRange(ranges, *order).withColumn("pid", F.spark_partition_id()))
    heads = placed.groupBy("pid").agg(F.max(F.struct(*KEY)).alias("head"))
    by_range = Window.orderBy("pid")
    after = heads.select("pid", F.coalesce(F.lead("head").over(by_range),
                                           F.first("head").over(by_range)).alias("after"))
    led = placed.withColumn("to", F.lead(F.struct(*KEY)).over(Window.partitionBy("pid").orderBy(*order)))
    to = F.coalesce("to", "after")
    return released(led.join(after, "pid").select(*KEY, "n_chars", "n", to["kid"].alias("nkid"), to["tid"].alias("ntid")))


def versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their next, versions) of (id, text): the versions have (kid, tid, nkid, ntid,
    edited_sha256, own, edited), the last two digests; one row a distinct document."""
    src = docs.select(F.coalesce(F.col("id").cast("long"), F.lit(FIRST_ID)).alias("kid"),
                      F.coalesce("text", F.lit("")).alias("text"))
    src = src.select("kid", F.xxhash64("text").alias("tid"), "text")
    ids = src.groupBy(*KEY).agg(F.max(F.length("text").cast("long")).alias("n_chars"), F.count(F.lit(1)).alias("n"))
    follow = next_documents(ids)
    if follow.where("n > 1").limit(1).count():
        src = src.dropDuplicates(KEY)
    # What a document gives to the one that it follows: the start of its text.
    give = follow.select(*[F.col(k).alias(f"to_{k}") for k in KEY], F.col("nkid").alias("kid"), F.col("ntid").alias("tid"),
                         F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    given = src.join(give, KEY).select(F.col("to_kid").alias("kid"), F.col("to_tid").alias("tid"), "cut",
                                       F.col("kid").alias("nkid"), F.col("tid").alias("ntid"),
                                       F.substring("text", F.lit(1), F.col("cut")).alias("start"))
    size = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), size - F.col("cut")), F.col("start"))
    made = (src.join(given, KEY).withColumn("changed", edited)
            .select(*KEY, *NEXT, F.sha2("changed", 256).alias("edited_sha256"),
                    digests(F.col("text")).alias("own"), digests(F.col("changed")).alias("edited")))
    return follow, released(made)


def _sketch(rows: DataFrame, size: int) -> DataFrame:
    """(nkid, ntid, v, c, cnt, x): the cells of the versions v of rows with arrays ``sets`` of
    (v, digests); cell -1 marks the row itself.  ``rows`` must be dealt by NEXT: the aggregate then
    needs no further exchange."""
    each = rows.select(*NEXT, F.explode("sets").alias("s")).select(*NEXT, F.col("s.v").alias("v"), F.col("s.d").alias("d"))
    flat = each.select(*NEXT, "v", F.explode(F.concat("d", F.array(F.lit(0).cast("long")))).alias("x"))
    cells = F.when(F.col("x") == 0, F.array(F.lit(-1).cast("long"))).otherwise(_cells(F.col("x"), size))
    return (flat.select(*NEXT, "v", "x", F.explode(cells).alias("c")).groupBy(*NEXT, "v", "c")
            .agg(F.sum(F.when(F.col("c") >= 0, 1).otherwise(0)).alias("cnt"), F.bit_xor("x").alias("x")))


def _subtract(sketch: DataFrame) -> DataFrame:
    """(nkid, ntid, kind, c, cnt, x): version 0 less version 1 (kind 1) and less version 2 (kind 2)."""
    kinds = F.when(F.col("v") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("v")))
    sign = F.when(F.col("v") == 0, F.col("cnt")).otherwise(-F.col("cnt"))
    return (sketch.select(*NEXT, "c", sign.alias("cnt"), "x", F.explode(kinds).alias("kind"))
            .groupBy(*NEXT, "kind", "c").agg(F.sum("cnt").alias("cnt"), F.bit_xor("x").alias("x"))
            .where("c = -1 or cnt <> 0 or x <> 0"))


def _peel(cells: DataFrame, size: int, part: int) -> DataFrame:
    """One round: the pure cells of one part give their digests, which leave the other parts.  A
    digest has one cell in a part, so none is taken out twice."""
    c, cnt, x = F.col("c"), F.col("cnt"), F.col("x")
    pure = c.between(part * size, (part + 1) * size - 1) & (F.abs(cnt) == 1) & _is_checked(x) & (_place(x, part, size) == c)

    def cell(place: Column, count: Column, digest: Column) -> Column:
        return F.struct(place.cast("long").alias("c"), count.cast("long").alias("cnt"), digest.cast("long").alias("x"))

    out = [cell(_place(x, p, size), -cnt, x) for p in range(3) if p != part] + [cell(F.lit(-1), F.lit(1), F.lit(0))]
    rows = F.when(pure, F.array(*out)).otherwise(F.array(cell(c, cnt, x)))
    return (cells.select(*NEXT, "kind", F.explode(rows).alias("r")).select(*NEXT, "kind", "r.*")
            .groupBy(*NEXT, "kind", "c").agg(F.sum("cnt").alias("cnt"), F.bit_xor("x").alias("x"))
            .where("c = -1 or cnt <> 0 or x <> 0"))


def _sets(made: DataFrame) -> DataFrame:
    """(nkid, ntid, sets): version 0 is the document, 1 its edited text, 2 the next document."""
    nxt = made.select(F.col("kid").alias("nkid"), F.col("tid").alias("ntid"), F.col("own").alias("next"))
    version = [F.struct(F.lit(v).alias("v"), F.col(c).alias("d")) for v, c in enumerate(("own", "edited", "next"))]
    return made.select(*NEXT, "own", "edited").join(nxt, NEXT).select(*NEXT, F.array(*version).alias("sets"))


def differences(made: DataFrame, part: int = PART) -> DataFrame:
    """(nkid, ntid, kind, d): how many paragraph digests the two versions of a kind do not share."""
    found: DataFrame | None = None
    failed: DataFrame | None = None
    size = part
    while True:
        rows = _sets(made)
        if failed is not None:
            # Only the failed pairs go on: the versions that they need, and their kinds.
            rows = rows.join(failed.groupBy(*NEXT).agg(F.collect_list("kind").alias("kinds")), NEXT)
            rows = rows.withColumn("sets", F.filter("sets", lambda s: (s["v"] == 0) | F.array_contains("kinds", s["v"])))
        cells = _subtract(_sketch(rows, size))
        for turn in range(ROUNDS):
            cells = _peel(cells, size, turn % 3)
        res = cells.groupBy(*NEXT, "kind").agg(
            F.sum(F.when(F.col("c") == -1, F.col("cnt")).otherwise(0)).alias("d"),
            F.sum((F.col("c") >= 0).cast("int")).alias("left"))
        if failed is not None:
            res = res.join(failed, [*NEXT, "kind"], "left_semi")
        res = released(res)
        done = res.where("left = 0").select(*NEXT, "kind", "d")
        found = done if found is None else found.union(done)
        failed = res.where("left > 0").select(*NEXT, "kind")
        if not failed.limit(1).count():
            return found
        size *= GROWTH
        if size > MAX_PART:
            raise RuntimeError("sketches do not peel")


def _strings(made: DataFrame, part: int) -> DataFrame:
    """(kid, tid, fingerprint, edited_fingerprint): the cells, in order, as hexadecimal text."""
    two = F.array(*[F.struct(F.lit(v).alias("v"), F.col(c).alias("d")) for v, c in enumerate(("own", "edited"))])
    ranges = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = made.select(F.col("kid").alias("nkid"), F.col("tid").alias("ntid"), two.alias("sets")).repartition(ranges, *NEXT)
    cell = F.concat_ws(":", F.lpad(F.hex("c"), 4, "0"), F.hex("cnt"), F.hex("x"))
    text = (_sketch(rows, part).withColumn("cell", F.when(F.col("c") >= 0, cell))
            .groupBy(*NEXT, "v").agg(F.array_join(F.array_sort(F.collect_list("cell")), " ").alias("f")))
    return released(text.groupBy(*NEXT).agg(
        F.max(F.when(F.col("v") == 0, F.col("f"))).alias("fingerprint"),
        F.max(F.when(F.col("v") == 1, F.col("f"))).alias("edited_fingerprint"))).withColumnsRenamed({"nkid": "kid", "ntid": "tid"})


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    next_id), one row per document."""
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    follow, made = versions(src)
    sizes = made.select(*KEY, *NEXT, "edited_sha256", F.size("own").alias("a"), F.size("edited").alias("b"))
    nxt = sizes.select(F.col("kid").alias("nkid"), F.col("tid").alias("ntid"), F.col("a").alias("z"))
    gap = differences(made, part).groupBy(*NEXT).agg(F.max(F.when(F.col("kind") == 1, F.col("d"))).alias("d_edited"),
                                                    F.max(F.when(F.col("kind") == 2, F.col("d"))).alias("d_next"))

    def near(other: str, d: str) -> Column:
        both = F.col("a") + F.col(other)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(d)) / (both + F.col(d)))

    rows = (sizes.join(nxt, NEXT).join(gap, NEXT).join(_strings(made, part), KEY)
            .join(follow.select(*KEY, "n_chars", "n"), KEY))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))

    def id_of(c: str) -> Column:
        return F.when(F.col(c) != FIRST_ID, F.col(c))

    return rows.select(id_of("kid").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       near("b", "d_edited").alias("near_edited"), near("z", "d_next").alias("near_next"),
                       id_of("nkid").alias("next_id"))
