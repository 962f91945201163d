"""Repeated lines, exact or within a few edits, with DataFrame functions only.

Edit join by segments: a line is cut into `edits` + 1 segments of even length; of two lines within
that distance one holds a segment of the other unchanged, moved by no more than the edits beside it.
Each line therefore names the hashes of its own segments and of those of its substrings that can be a
segment of a line as long or a little shorter. Lines that meet in a hash are candidates; a banded
bit-parallel edit distance decides.

Every text is one line, however many documents have it, before hashes are named. Only lines whose hash is shared
go further than the first pass. Within a hash all lines are compared with its pivot; then only lines outside their hash's main group are compared with the others, and letter counts
decide inside that join which pairs to verify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfattr.llm.common import keyed, stored, unpacked
from perfattr.llm.components import components, merged
from perfattr.llm.near_duplicates import SHINGLE, THRESHOLD
from perfattr.sources.storage import release

EDITS = 2
#: Characters from which on a line is compared within edits; shorter ones are only found equal.
LEAST_CHARS = 20
#: A line without any of these is never compared: blank lines, rules, brackets.
SAYS_SOMETHING = r"[\p{L}\p{N}]"
#: Share of its remaining characters that a copy must have from one document.
COPY_SHARE = 0.5
#: Letters whose counts bound the distance from below.
LETTERS = "enirtasodhlucmgk"


def _parts(rest: int, edits: int) -> list[tuple[int, int, int]]:
    """Of a line of n = (edits + 1) * base + rest characters, the substrings that may be a segment of a line
    within `edits` and not longer: (i, a, b) for segment i, i * base + a characters in, base + b characters long.

    Segments of a line have base characters, the last `rest` one more. An unchanged segment i of a line that is
    `less` characters shorter has moved by no more than the i edits that fit before it, and seen from the end by
    no more than those that fit behind it.
    """
    of = edits + 1
    found = set()
    for less in range(of):
        down, odd = divmod(rest - less, of)
        for i in range(of):
            late = i - (of - odd)  # how many of the longer segments stand before this one, if not negative
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                found.add((i, i * down + max(0, late) + shift, down + (late >= 0)))
    return sorted(found)


def with_buckets(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """`line` and `buckets` of lines (line, text, chars): the hashes under which a line meets every line within
    `edits` of it, if both have more characters than that."""
    of = edits + 1
    sized = lines.select(
        "line", "text", F.expr(f"cast(chars div {of} as int)").alias("base"), F.expr(f"chars % {of}").alias("rest")
    )

    def hashes(rest: int) -> Column:
        base = F.col("base")
        return F.array(
            *[F.xxhash64(F.lit(i), F.substring("text", i * base + (a + 1), base + b)) for i, a, b in _parts(rest, edits)]
        )

    found = hashes(0)
    for rest in range(1, of):
        found = F.when(F.col("rest") == rest, hashes(rest)).otherwise(found)
    return sized.select("line", F.array_distinct(found).alias("buckets"))


def letter_counts(line: Column) -> Column:
    """Counts of some letters, each modulo 16, in one long."""
    n = F.length(line)
    parts = [
        F.shiftleft(F.pmod(n - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(16)).cast("long"), 4 * k)
        for k, c in enumerate(LETTERS)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def _may_be_near(a: str, b: str, edits: int) -> Column:
    """An edit changes the counts of two letters by one at most."""
    apart = []
    for k in range(len(LETTERS)):
        x, y = (F.shiftright(c, 4 * k).bitwiseAND(15) for c in (a, b))
        by = F.abs(x - y)
        apart.append(F.least(by, 16 - by))
    return sum(apart[1:], apart[0]) <= 2 * edits


def _without_common_front(most: int):
    """Of a struct of strings x and y, what follows their common front, reversed.

    The front's length is searched by powers of two: it grows by one if that many more characters agree.
    """
    powers = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])

    def cut(pair: Column) -> Column:
        def longer(n: Column, by: Column) -> Column:
            x, y = F.substring(pair.x, n + 1, by), F.substring(pair.y, n + 1, by)
            return n + F.when((x == y) & (F.length(x) == by), by).otherwise(0)

        def rest(n: Column) -> Column:
            return F.struct(
                *[F.reverse(F.substring(pair[c], n + 1, F.length(pair[c]))).alias(c) for c in ("x", "y")]
            )

        # A lambda binds what is used twice.
        return F.transform(F.array(F.aggregate(powers, F.lit(0), longer)), rest).getItem(0)

    return cut


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings, or a number above `edits`, by bit vectors over the band (Hyyrö).

    Bit k of the vectors stands for row j - edits + k of column j: vertical steps of the matrix up (vp) and down
    (vn). The distance is followed along the band's lowest diagonal down to the last row, then along it.
    """
    # A common end changes no distance and makes the first string longer than the band.
    end = "\x00" * (edits + 1)
    chars = F.struct(
        F.split(F.concat(a, F.lit(end)), "").alias("left"), F.split(F.concat(b, F.lit(end)), "").alias("right")
    )
    width = 2 * edits + 1
    full = (1 << width) - 1
    none = F.lit(0).cast("long")

    def column(left: Column, right: Column, m: Column, state: Column, j: Column) -> Column:
        same = none
        for k in range(width):
            row = j - edits + k
            char = F.when((row >= 1) & (row <= m), F.get(left, row - 1) == F.get(right, j - 1)).otherwise(False)
            same = same + F.when(char, F.lit(1 << k).cast("long")).otherwise(none)

        # Lambdas bind what is used more than once: x, then d0, then hp and hn.
        def with_same(x: Column) -> Column:
            d0 = (
                (x.bitwiseAND(state.vp) + state.vp).bitwiseXOR(state.vp).bitwiseOR(x).bitwiseOR(state.vn)
            ).bitwiseAND(full)
            return F.transform(F.array(d0), with_diagonal).getItem(0)

        def with_diagonal(d0: Column) -> Column:
            hp = state.vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(state.vp)).bitwiseAND(full))
            hn = d0.bitwiseAND(state.vp)
            return F.transform(F.array(F.struct(hp.alias("hp"), hn.alias("hn"))), lambda h: following(d0, h)).getItem(0)

        def following(d0: Column, h: Column) -> Column:
            down = F.shiftrightunsigned(d0, 1)
            at = (m - j + edits).cast("int")  # the last row's bit, once the band has reached it

            def bit(v: Column) -> Column:
                # Shifting by a column needs SQL's function; the lowest bit is that row's.
                return F.call_function("shiftright", v, at).bitwiseAND(1)

            diagonal = 1 - F.shiftright(d0, 2 * edits).bitwiseAND(1)
            step = F.when(j + edits <= m, diagonal).otherwise(bit(h.hp) - bit(h.hn))
            return F.struct(
                h.hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(h.hp)).bitwiseAND(full)).alias("vp"),
                down.bitwiseAND(h.hp).alias("vn"),
                (state.distance + step).alias("distance"),
            )

        return F.transform(F.array(same), with_same).getItem(0)

    # Column 0: rows from 1 on rise by one; seen from column 1 these are the upper bits of the band.
    first = F.struct(
        F.lit(full & ~((1 << edits) - 1)).cast("long").alias("vp"),
        none.alias("vn"),
        F.lit(edits).cast("long").alias("distance"),
    )
    far = F.lit(edits + 1).cast("long")

    def distance(pair: Column) -> Column:
        m, n = F.size(pair.left), F.size(pair.right)

        def step(state: Column, j: Column) -> Column:
            return column(pair.left, pair.right, m, state, j)

        walked = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s.distance)
        return F.when(F.abs(m - n) <= edits, walked).otherwise(far)

    return F.transform(F.array(chars), distance).getItem(0)


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, longest: int) -> DataFrame:
    """The pairs of lines (a, b) within the distance. What they have in common at both ends is cut off first."""
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("line").alias("b"), F.col("text").alias("y")), "b")
    both = both.where(F.abs(F.length("x") - F.length("y")) <= edits)
    cut = _without_common_front(longest)
    rest = F.transform(F.transform(F.array(F.struct("x", "y")), cut), cut)
    near = F.transform(rest, lambda pair: banded_distance(pair.x, pair.y, edits) <= edits).getItem(0)
    return both.where(near).select("a", "b")


def lines_of(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
        F.posexplode(F.split(F.col(text_column), "\n")).alias("line_no", "text"),
    )
    return rows.withColumn("line", F.xxhash64("text")).withColumn("chars", F.length("text"))


def near_lines(lines: DataFrame, *, edits: int = EDITS) -> DataFrame:
    """`node` (xxhash64 of a line) and `component` of all lines that are linked with another text."""
    # Copies are reduced before the shuffle; lines of one hash are one text.
    known = lines.groupBy("line").agg(F.any_value("text").alias("text"))
    known = stored(known.withColumn("chars", F.length("text")), "known", "zstd")
    # The outer form: the other one would add a filter that computes the array twice.
    each = with_buckets(known, edits).select("line", F.explode_outer("buckets").alias("bucket"))
    pivots = each.groupBy("bucket").agg(F.min("line").alias("pivot"), F.max("line").alias("last"))
    pivots = stored(pivots.where("pivot < last").select("bucket", "pivot"), "pivots")
    shared = stored(each.join(pivots, "bucket"), "shared")
    involved = stored(shared.select("line").distinct(), "involved")
    # The same plan at every size: how many lines are involved follows the corpus.
    texts = known.join(involved.hint("merge"), "line", "left_semi")
    texts = stored(texts.withColumn("letters", letter_counts(F.col("text"))), "texts", "zstd")
    release(known, pivots, involved)
    longest = texts.agg(F.max("chars")).first()[0] or 1
    known = texts.select("line", "chars", "letters")

    def close(x: str, y: str) -> Column:
        return (F.abs(F.col(f"{x}_chars") - F.col(f"{y}_chars")) <= edits) & _may_be_near(
            F.col(f"{x}_letters"), F.col(f"{y}_letters"), edits
        )

    pairs = shared.where("line != pivot").select(F.col("line").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(known.toDF("a", "a_chars", "a_letters"), "a").join(known.toDF("b", "b_chars", "b_letters"), "b")
    pairs = stored(pairs.where(close("a", "b")).select("a", "b"), "pairs")
    edges = stored(_verified(pairs, texts, edits, longest), "links")
    labels = components(edges)

    placed = shared.select("bucket", F.col("line").alias("node")).join(labels, "node", "left")
    placed = stored(placed.select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    groups = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = groups.groupBy("bucket").agg(F.max_by("component", "n").alias("main"), F.count("*").alias("groups"))
    main = stored(main.where("groups > 1").select("bucket", "main"), "main")
    members = stored(placed.join(main, "bucket").join(known.withColumnRenamed("line", "node"), "node"), "members")
    left = members.where("component != main").select(
        "bucket", *(F.col(c).alias(f"a_{c}") for c in ("node", "component", "chars", "letters"))
    )
    right = members.select(
        "bucket", "main", *(F.col(c).alias(f"b_{c}") for c in ("node", "component", "chars", "letters"))
    )
    rest = left.join(right, "bucket").where(
        F.expr("a_component != b_component and (b_component = main or a_node < b_node)") & close("a", "b")
    )
    rest = rest.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    rest = stored(rest, "rest")
    if rest.isEmpty():
        return labels
    return merged(labels, stored(_verified(rest, texts, edits, longest), "links"))


def _placed(documents: DataFrame, id_column: str, text_column: str, edits: int, least_chars: int) -> DataFrame:
    """Compared lines of the documents, each given once: doc_id, text_key, line_no, chars, first, repeated.

    `first` is the place of the class's first line, or null if the class has no other.
    """
    lines = lines_of(documents, id_column, text_column)
    compared = lines.where(F.col("text").rlike(SAYS_SOMETHING))
    # Two hashes tell equal lines at any size of corpus; links were verified on texts.
    places = compared.select(
        "doc_id", "text_key", "line_no", "chars", "line", F.xxhash64(F.lit(1), "text").alias("second")
    )
    places = stored(places.distinct(), "places")
    longer = compared.where(F.col("chars") >= max(least_chars, edits + 1))
    near = near_lines(longer.select("line", "text"), edits=edits)
    named = places.join(near.withColumnRenamed("node", "line"), "line", "left").select(
        "doc_id",
        "text_key",
        "line_no",
        "chars",
        F.coalesce("component", "line").alias("class"),
        F.when(F.col("component").isNull(), F.col("second")).otherwise(0).alias("second"),
    )
    named = stored(named, "named")
    release(places)
    place = F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "text_key", "line_no")
    first = named.groupBy("class", "second").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("class", "second", "first"), "first")
    return named.join(first, ["class", "second"], "left").withColumn(
        "repeated", F.coalesce(place != F.col("first"), F.lit(False))
    )


def repeated_lines(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    edits: int = EDITS,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """One row per document: doc_id, text_key, n_lines, n_repeated, removed.

    Lines (between line feeds) with a letter or digit are in one class if they are equal, or linked by edit distances of
    `edits` or less between lines of `least_chars` characters or more. A class's first line stays: that of the smallest
    document id (null first), then text key, then number; all others are repeated, whichever documents they stand in
    and however much of one they are. `removed` has their numbers (from 0). Null text has no line, empty text one, and
    no line of them is compared. Rows that repeat id and text are one document, given once for each. Extra columns are
    not read.
    """
    again = _placed(documents, id_column, text_column, edits, least_chars).where("repeated")
    marks = again.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
        F.coalesce(F.size(F.split(F.col(text_column), "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    marks = marks.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    found = rows.join(marks, rows.doc_id.eqNullSafe(marks.id) & (rows.text_key == marks.key), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select(
        "doc_id",
        "text_key",
        F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.size(removed).cast("long").alias("n_repeated"),
        removed.alias("removed"),
    )


def shingles(text: Column) -> Column:
    """The distinct shingles that `near_duplicates` links documents by, as an array of hashes."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), "")

    # Hashes skip the nulls behind the last word: fewer words are one shingle. Lambdas bind what is used twice.
    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        each = F.transform(starts, lambda k: F.xxhash64(*[F.get(w, k + j) for j in range(SHINGLE)]))
        return F.when(F.size(w) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), hashes).getItem(0)


def _main_source(repeats: Column, own: Column) -> Column:
    """Of repeats sorted by source, `main`, the source other than the document itself that has the most characters,
    and `most`, their number."""
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("at"), none.alias("n"), none.alias("main"), none.alias("most"))

    def step(state: Column, r: Column) -> Column:
        n = F.when(r.source == own, none).otherwise(F.when(r.source == state["at"], state["n"]).otherwise(none) + r.chars)
        more = n > state["most"]
        return F.struct(
            r.source.alias("at"),
            n.alias("n"),
            F.when(more, r.source).otherwise(state["main"]).alias("main"),
            F.when(more, n).otherwise(state["most"]).alias("most"),
        )

    return F.aggregate(repeats, start, step)


def _cut(text: Column, removed: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains(removed, k))
    return F.when(removed.isNotNull(), F.array_join(kept, "\n")).otherwise(text)


def removed_lines(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    edits: int = EDITS,
    least_chars: int = LEAST_CHARS,
    copy_share: float = COPY_SHARE,
) -> DataFrame:
    """doc_id, text_key and `removed` of the documents that lose lines, if only copies of a document keep any.

    Repeated are the lines that `repeated_lines` says. All are removed, those of the document itself too, but for a
    copy's: it keeps the lines that stand first in the one document it is a copy of. That is the document most of its
    repeated characters come from, if these are more than `copy_share` of what the copy would keep, if the other is
    not such a copy itself, and if `near_duplicates` links the two texts as this leaves them: the near duplicates'
    stage then keeps one of both.
    """
    again = _placed(documents, id_column, text_column, edits, least_chars).select(
        "doc_id",
        "text_key",
        "chars",
        F.when(
            F.col("repeated"),
            F.struct(F.xxhash64("first.doc_id", "first.text_key").alias("source"), "line_no", "chars"),
        ).alias("repeat"),
    )
    # A list per document, by source: no further shuffle of lines.
    marks = again.groupBy("doc_id", "text_key").agg(
        F.sum("chars").alias("n_chars"), F.sort_array(F.collect_list("repeat")).alias("repeats")
    )
    marks = stored(
        marks.where(F.size("repeats") > 0).select("*", F.xxhash64("doc_id", "text_key").alias("doc")), "marks"
    )
    copies = marks.select(
        "doc",
        (F.col("n_chars") - F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r.chars)).alias("n_own"),
        _main_source(F.col("repeats"), F.col("doc")).alias("best"),
    )
    copies = copies.where("best.most > 0").where(F.col("best.most") > (F.col("n_own") + F.col("best.most")) * copy_share)
    copies = stored(copies.select("doc", F.col("best.main").alias("of")), "copies")
    copies = stored(copies.join(copies.select(F.col("doc").alias("of")), "of", "left_anti").select("doc", "of"), "copies")

    def without(copies: DataFrame) -> DataFrame:
        lost = F.filter("repeats", lambda r: F.col("of").isNull() | (r.source != F.col("of")))
        removed = F.sort_array(F.transform(lost, lambda r: r.line_no))
        rows = marks.join(copies, "doc", "left").select("doc", "doc_id", "text_key", removed.alias("removed"))
        return rows.where(F.size("removed") > 0)

    ends = stored(copies.select("doc").union(copies.select("of")).distinct(), "ends")
    texts = documents.select(
        F.xxhash64(F.col(id_column).cast("long"), F.xxhash64(text_column)).alias("doc"), F.col(text_column).alias("text")
    )
    # Copies of a row are reduced before the shuffle.
    texts = texts.join(ends.hint("merge"), "doc", "left_semi")
    texts = texts.groupBy(F.xxhash64("doc", F.lit("text"))).agg(
        F.any_value("doc").alias("doc"), F.any_value("text").alias("text")
    )
    lost = without(copies).join(ends, "doc", "left_semi").select("doc", "removed")
    sets = texts.join(lost, "doc", "left").select("doc", shingles(_cut(F.col("text"), F.col("removed"))).alias("set"))
    sets = stored(sets, "sets")
    pairs = copies.join(sets.toDF("doc", "a"), "doc").join(sets.toDF("of", "b"), "of")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("a", "b")))
    least, of = THRESHOLD
    linked = pairs.where((F.col("both") > 0) & (of * F.col("both") >= least * (F.size("a") + F.size("b") - F.col("both"))))
    return without(stored(linked.select("doc", "of"), "linked")).select("doc_id", "text_key", "removed")


def without_repeated_lines(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    linked_copies: bool = False,
    **options,
) -> DataFrame:
    """The documents with the removed lines taken out of their text; all rows and columns stay.

    With `linked_copies` the lines of `removed_lines`, otherwise those of `repeated_lines`.
    """
    options = {"id_column": id_column, "text_column": text_column, **options}
    if linked_copies:
        cut = removed_lines(documents, **options)
    else:
        cut = repeated_lines(documents, **options).where("n_repeated > 0").select("doc_id", "text_key", "removed")
        cut = cut.distinct()
    cut = stored(cut, "removed")
    rows = keyed(documents, id_column, text_column)
    rows = rows.join(cut, (rows.key == cut.text_key) & rows.id.eqNullSafe(cut.doc_id), "left")
    text = _cut(F.col("row").getField(text_column), F.col("removed"))
    return unpacked(rows, documents.columns, **{text_column: text})
