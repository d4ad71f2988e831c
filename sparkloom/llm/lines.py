"""Line dedup by MinHash: signatures, banding, exact Jaccard, union-find. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, hash_masks, lookup, saved, scratch
from .similar import few, similar_sets


@dataclass(frozen=True)
class LineOptions:
    """All overlapping character shingles of ``width``; a line of fewer characters is one shingle.

    A signature has ``bands * rows`` minima of one hash of the shingles, each over the part of them that the hash puts in its
    bin (one-permutation hashing).  Only hashes so small that a bin has ``sure`` of them on average are held: a larger minimum,
    which a bin has with probability exp(-sure), counts as none.  A bin without a minimum takes another's, in an order that is the
    same for all lines. At a similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** rows) ** bands (0.997 as
    set; above 0.9999 at 0.9).  Lines of up to ``short`` shingles, which fill few bins, have exact keys besides.
    ``least`` of the minima agree in a pair that is compared, unless one of both has under ``4 * short`` shingles: at 0.8 all but 1 in
    3,000 do. ``broadcast_rows`` bounds what is broadcast; beyond, the same join is shuffled."""

    width: int = 8
    bands: int = 8
    rows: int = 3
    similarity: float = 0.8
    short: int = 24
    sure: float = 5.0
    least: int = 12
    broadcast_rows: int = 500_000

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def _shingles(line: Column, o: LineOptions) -> Column:
    """XXH64 of every shingle, in an array, as ``_hashed`` has them."""
    one = lambda e: F.transform(F.sequence(F.lit(1), 4 * _last(e, o) + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(e, at, F.lit(4 * o.width))))
    return F.get(F.transform(F.array(_coded(line)), one), F.lit(0))  # as a lambda's argument the line is coded once, not for every shingle


def _coded(line: str | Column) -> Column:
    """The line as UTF-32, where a shingle is a slice at a known place."""
    return F.encode(line, "UTF-32").alias("e")


def _last(coded: str | Column, o: LineOptions) -> Column:
    return F.greatest(F.lit(0), (F.octet_length(coded) / 4).cast("int") - o.width)


def _hashed(lines: DataFrame, o: LineOptions, bound: float | None = None) -> DataFrame:
    """A row for every shingle of the column ``line``: the other columns, its place ``k``, XXH64 ``x``, and the line's ``size`` in shingles.

    In generated code throughout.  With a ``bound`` only about as many a line, those of the smallest hashes, and the first.
    """
    kept = [c for c in lines.columns if c != "line"]
    sized = lines.select(*kept, _coded("line")).select(*kept, "e", (_last("e", o) + 1).alias("size"))
    place, hashed = F.shiftright(F.col("at") - 1, 2).alias("k"), F.expr(f"xxhash64(substring(e, at, {4 * o.width}))")
    at = F.explode(F.sequence(F.lit(1), 4 * F.col("size") - 3, F.lit(4))).alias("at")
    if bound is None:
        return sized.select(*kept, "e", "size", at).select(*kept, "size", place, hashed.alias("x"))
    most = F.when(F.col("size") <= bound, F.lit(2**63 - 1)).otherwise((F.lit(bound * 2.0**63) / F.col("size")).cast("long"))  # once a line
    # what depends on the partition isn't copied into the filter: else shingles that are held would be cut and hashed twice
    once = hashed.bitwiseXOR(F.spark_partition_id() * 0)
    each = sized.select(*kept, "e", "size", most.alias("most")).select(*kept, "e", "size", "most", at).select(*kept, "size", "most", "at", once.alias("x"))
    return each.where((F.col("at") == 1) | (F.shiftrightunsigned("x", 1) <= F.col("most"))).select(*kept, "size", place, "x")


def _agree(a: str, b: str, o: LineOptions) -> Column:
    """Enough minima agree, or a line is too short to tell."""
    agree = sum(((F.col(f"{a}m{j}") == F.col(f"{b}m{j}")).cast("int") for j in range(o.bins)), F.lit(0))
    return (F.least(f"{a}size", f"{b}size") < 4 * o.short) | (agree >= o.least)


def _may_be_similar(a: str, b: str, o: LineOptions) -> Column:
    """False only for sets below the similarity: their symmetric difference is at most (1 - s) / (1 + s) of both sizes,
    the smaller at least s of the larger; sketches differ in no more bits than the sets in elements."""
    sizes = F.col(f"{a}size"), F.col(f"{b}size")
    differ = sum((F.bit_count(F.col(f"{a}k{w}").bitwiseXOR(F.col(f"{b}k{w}"))) for w in range(SKETCH)), F.lit(0))
    near = differ <= F.floor((1 - o.similarity) / (1 + o.similarity) * (sizes[0] + sizes[1]) + 1e-9)
    return (F.least(*sizes) >= o.similarity * F.greatest(*sizes) - 1e-9) & near


def _named(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(*[F.col(c).alias(key if c == "h" else f"{prefix}{c}") for c in df.columns])


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, own, pos, line, h)``: lines with more than white space of documents with an id; ``own`` is the whole text's XXH64
    and tells rows with one id apart, ``h`` the line's."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    split = own.select("doc", "own", F.posexplode(F.split("text", "\n")).alias("pos", "line"))  # own is worked out for a text, not for each of its lines
    return split.where(F.ltrim("line", F.lit(" \t\n\x0b\f\r")) != "").withColumn("h", F.xxhash64("line"))


def _filled(minima: str, o: LineOptions) -> Column:
    """The array ``minima``, with those of other bins (in an order of its own for each) in place of missing ones."""
    masks = hash_masks(o.bins * o.bins)
    order = F.array(*[F.array(*map(F.lit, sorted(range(o.bins), key=lambda k: masks[o.bins * j + k]))) for j in range(o.bins)])  # noqa: B023
    there = lambda x: x < F.lit(1 << 32)
    other = lambda j: F.get(F.filter(F.transform(F.get(order, j), lambda i: F.get(minima, i)), there), F.lit(0))
    return F.transform(minima, lambda x, j: F.when(there(x), x).otherwise(other(j)))


def signatures(occ: DataFrame, o: LineOptions) -> DataFrame:
    """``(h, first_doc, n, size, m0, m1, ...)`` for every distinct line: its lines, shingles and minima.

    Shingles are cut, hashed and folded in generated code.  All is folded by the line's hash before the shuffle, so neither
    a line that a third of all documents hold nor its text is sent more than once a task.
    """
    each = _hashed(occ.select("doc", "h", "line"), o, bound=o.sure * o.bins)
    bin_ = F.shiftright(F.col("x").bitwiseAND(0xFFFFFF) * o.bins, 24).alias("bin")
    held = each.select("doc", "h", "k", "size", bin_, F.shiftrightunsigned("x", 33).alias("y"))
    # a shingle changes the minimum of its bin alone: a filter costs the other bins a comparison, not a minimum read and written
    minima = [F.expr(f"min(y) FILTER (WHERE bin = {j})").alias(f"m{j}") for j in range(o.bins)]
    line = [F.expr(f"{what} FILTER (WHERE k = 0)").alias(name) for what, name in (("min(doc)", "first_doc"), ("count(*)", "n"), ("max(size)", "size"))]
    folded = held.groupBy("h").agg(*line, *minima)
    kept = ["h", "first_doc", "n", "size"]
    every = [F.coalesce(f"m{j}", F.lit(1 << 32)) for j in range(o.bins)]
    missing = folded.select(*kept, (F.greatest(*every) >= F.lit(1 << 32) if o.bins > 1 else F.lit(True)).alias("missing"), F.array(*every).alias("minima"))
    filled = missing.select(*kept, F.when(F.col("missing"), _filled("minima", o)).otherwise(F.col("minima")).alias("filled"))
    return filled.select(*kept, *[F.get("filled", F.lit(j)).cast("int").alias(f"m{j}") for j in range(o.bins)])


def bands(known: DataFrame, o: LineOptions) -> DataFrame:
    """``(band, h)`` of signatures."""
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b * o.rows + r}") for r in range(o.rows)]) for b in range(o.bands)]
    return known.select(F.explode(F.array(*keys)).alias("band"), "h")


def short_keys(lines: DataFrame, o: LineOptions) -> DataFrame:
    """``(band, h)`` of lines (h, line) of at most ``short`` shingles: two of them that are similar share a key for certain.

    Sets of n shingles share t = ceil(s * n) of them with any similar set.  In order of their hashes the first
    two that are shared are then among the first n - t + 2 of both, and each two of these are a key.  With t under
    2 (n = 1) the shingle is the key: a similar set equals it.
    """
    sets = _hashed(lines.where(F.length("line") < o.short + o.width).distinct(), o).groupBy("h").agg(F.sort_array(F.collect_set("x")).alias("set"))
    n = F.size("set")
    sets = sets.select("h", F.slice("set", F.lit(1), n - F.ceil(o.similarity * n - F.lit(1e-9)).cast("int") + 2).alias("first"), n.alias("n"))
    twos = F.flatten(F.transform("first", lambda x, i: F.transform(F.slice("first", i + 2, F.size("first")), lambda y: F.xxhash64(F.lit("short"), x, y))))
    return sets.select(F.explode(F.when(F.col("n") == 1, F.transform("first", lambda x: F.xxhash64(F.lit("short"), x))).otherwise(twos)).alias("band"), "h")


SKETCH = 16  # words of 64 bits


class LineSets:
    """Shingle sets of distinct lines.  Signatures tell which pairs may be similar; of these all shingles are compared, from
    the lines' texts.  Where many lines of a band are held against each other, pairs must also pass XOR sketches of
    all shingles, one bit for each."""

    def __init__(self, docs: DataFrame, known: DataFrame, o: LineOptions, id_col: str, text_col: str):
        self.docs, self.known, self.o, self.id_col, self.text_col = docs, known, o, id_col, text_col

    def lines(self, wanted: DataFrame) -> DataFrame:
        """``(h, line)`` of ``wanted`` (h, first_doc), from one document of each; of rows that share an id perhaps twice."""
        rows = self.o.broadcast_rows
        carriers = saved(wanted.select(F.col("first_doc").alias(self.id_col)).distinct(), "carriers")
        held = self.docs.join(few(carriers, rows), self.id_col, "left_semi")
        split = held.select(F.col(self.id_col).alias("doc"), F.explode(F.array_distinct(F.split(self.text_col, "\n"))).alias("line"))
        return split.withColumn("h", F.xxhash64("line")).join(few(wanted, rows), "h").where("doc = first_doc").select("h", "line")

    def prepare(self, wanted: DataFrame) -> None:
        self.signed = saved(self.known.join(few(wanted, self.o.broadcast_rows), "h", "left_semi"), "signed", plain=True)
        self.sketches: DataFrame | None = None
        self.texts = saved(self.lines(self.signed.select("h", "first_doc")), "texts", plain=True)

    def near(self, pairs: DataFrame) -> DataFrame:
        signed = self.signed.drop("first_doc", "n")
        left = pairs.join(_named(signed, "a_", "a"), "a")
        both = left.join(_named(signed, "b_", "_b"), (F.col("b") == F.col("_b")) & _agree("a_", "b_", self.o))
        return both.select(*pairs.columns)

    def near_pivots(self, ranked: DataFrame, done: int, until: int) -> DataFrame:
        if done > 1:
            return self._held(ranked, self._sketched, _may_be_similar, done, until)
        # bands that are through after this step are small: their pairs go by signature alone
        small = self._held(ranked.where(F.col("m") <= until), self.signed.drop("first_doc", "n"), _agree, done, until)
        return small.union(self._held(ranked.where(F.col("m") > until), self._sketched, _may_be_similar, done, until))

    def _sketched(self, ranked: DataFrame) -> DataFrame:
        if self.sketches is None:  # later ones are some of the first
            asked = self.texts.join(few(ranked.select("h").distinct(), self.o.broadcast_rows), "h", "left_semi")
            # dealt out by line, and a line's shingles told apart in its row: the aggregate holds a row a line, not one a shingle
            each = asked.repartition("h").select("h", F.explode(F.array_distinct(_shingles(F.col("line"), self.o))).alias("x"))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int"))
            each = each.select("h", F.shiftrightunsigned("x", 6).bitwiseAND(SKETCH - 1).alias("w"), bit.alias("bit"))
            held = [F.coalesce(F.expr(f"bit_xor(bit) FILTER (WHERE w = {w})"), F.lit(0)).alias(f"k{w}") for w in range(SKETCH)]
            self.sketches = saved(each.groupBy("h").agg(F.count("*").cast("int").alias("size"), *held), "sketches")
        return self.sketches

    def _held(self, ranked: DataFrame, by, alike, done: int, until: int) -> DataFrame:
        """Pairs of pivots and later members of their bands that are ``alike`` by the columns of ``by``."""
        if ranked.isEmpty():
            return ranked.sparkSession.createDataFrame([], "ha long, hb long, la long, lb long")
        full = saved(ranked.join(by(ranked) if callable(by) else by, "h"), "held")
        pivots = full.where((F.col("rank") > done) & (F.col("rank") <= until))
        near = (F.col("a_band") == F.col("b_band")) & F.expr("b_rank > a_rank and a_label <> b_label") & alike("a_", "b_", self.o)
        return _named(pivots, "a_", "ha").join(_named(full, "b_", "hb"), near).select("ha", "hb", F.col("a_label").alias("la"), F.col("b_label").alias("lb"))

    def similar(self, pairs: DataFrame) -> DataFrame:
        both = pairs
        for c in "ab":
            both = both.join(self.texts.select(F.col("h").alias(c), F.col("line").alias(f"{c}_line")), c)
        both = both.select(*pairs.columns, *[_shingles(F.col(f"{c}_line"), self.o).alias(f"{c}_each") for c in "ab"])
        united = both.select("*", F.size(F.array_union("a_each", "b_each")).alias("all"))
        # at most so many are shared, fewer if a line repeats some: where that is not enough, none are looked up
        most, enough = F.size("a_each") + F.size("b_each") - F.col("all"), self.o.similarity * F.col("all") - 1e-9
        shared = F.when(most >= enough, F.size(F.array_intersect("a_each", "b_each"))).otherwise(most).alias("shared")
        counted = saved(united.select(*pairs.columns, shared, "all"), "counted")
        return counted.where(F.col("shared") >= enough).select(*pairs.columns)


def similar_lines(docs: DataFrame, known: DataFrame, o: LineOptions, id_col: str, text_col: str) -> DataFrame:
    """``(h, component)`` of distinct lines that are similar to another one.

    Lines that share a band, or a key of short lines, are candidates; shingles themselves are compared.
    """
    sets = LineSets(docs, known, o, id_col, text_col)
    brief = saved(known.where(F.col("size") <= o.short).select("h", "first_doc"), "brief")
    keys = bands(known, o).union(saved(short_keys(sets.lines(brief), o), "short"))
    return similar_sets(keys, sets, o.broadcast_rows)


def duplicate_lines(docs: DataFrame, o: LineOptions = LineOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, own, removed)``: for documents that lose lines, their sorted positions (from 0); ``own`` is the whole text's XXH64.

    Equal lines, and lines in one component of similar ones, are a class; of each class the line of
    the smallest id stays, there (if rows share the id) of the smallest text hash, and there of the smallest position.
    """
    with scratch() as keep:
        occ = occurrences(docs, id_col, text_col)
        known = saved(signatures(occ, o), "lines", plain=True)
        graph = similar_lines(docs, known, o, id_col, text_col)
        named = known.select("h", "first_doc", "n").join(graph, "h", "left").where("n > 1 or component is not null")
        named = saved(named.withColumn("component", F.coalesce("component", "h")), "named")
        first = named.groupBy("component").agg(F.min("first_doc").alias("keep_doc"))
        classes = saved(named.join(first, "component").select("h", "n", "component", "keep_doc"), "classes")
        size = classes.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).first()
        if size.rows <= o.broadcast_rows:
            named = occ.select("doc", "own", "pos", "h").join(F.broadcast(classes.drop("n")), "h")
        else:
            named = lookup(occ.select("doc", "own", "pos", "h"), classes, "h", "n", "pos", size["lines"]).where("component is not null")
        again = saved(named.select("doc", "own", "pos", "component", "keep_doc"), "again")
        kept = again.where("doc = keep_doc").groupBy("component", "doc").agg(F.min(F.struct("own", "pos")).alias("at")).select("doc", "at.own", "at.pos")
        gone = again.select("doc", "own", "pos").join(kept, ["doc", "own", "pos"], "left_anti").distinct()
        return keep(saved(gone.groupBy("doc", "own").agg(F.sort_array(F.collect_list("pos")).alias("removed")), "removed"))


def remove_duplicate_lines(docs: DataFrame, o: LineOptions = LineOptions(), id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with all but one line of each class removed from the texts; other lines and all columns stay as they are.

    Lines of white space stay.  Null and empty texts have no lines; rows with a null id are left as they are and don't
    take part; rows with one id but different texts are documents of their own, rows that agree in both count as one and come out alike.
    ``report`` adds ``_removed`` (positions, null if none) in place of a column of that name. Lines, and texts under one id, are told
    apart by a 64-bit hash; two different lines meet in it with a chance of n^2 / 2^65.
    """
    doc, own, gone_at, parts = free_names(docs, "_doc", "_own", "_gone", "_parts")
    gone = duplicate_lines(docs, o, id_col, text_col).select(F.col("doc").alias(doc), F.col("own").alias(own), F.col("removed").alias(gone_at))
    size = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(gone_at)), F.lit(0)).alias("lines")).first()
    small = size.docs <= o.broadcast_rows and size.lines <= 4 * o.broadcast_rows
    joined = docs.join(F.broadcast(gone) if small else gone, (docs[id_col] == gone[doc]) & (F.xxhash64(docs[text_col]) == gone[own]), "left")
    joined = joined.withColumn(parts, F.when(F.col(gone_at).isNotNull(), F.split(text_col, "\n")))
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone_at)
    text = F.when(F.col(gone_at).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if not (report and c == "_removed")]
    return joined.select(*columns, *([F.col(gone_at).alias("_removed")] if report else []))
