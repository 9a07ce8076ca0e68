"""Document fingerprints: invertible Bloom lookup sketches (DataFrame expressions only).

A text is cut into paragraphs (lines; long lines after LINE characters, at the
next sentence end if one follows soon). The set of its paragraph digests, each
with the paragraph's number of occurrences, is put into cells: every digest is
added to one cell in each of three parts; a cell holds a count, the XOR of its
digests and the XOR of their check values. The fingerprint is the sketch of
3 * BASE cells, as text.

Two versions are compared by subtracting cells and peeling: a cell with count
1 or -1 and a valid check value holds one differing digest, which is taken out
of its other cells, and so on until all cells are empty. For whole texts the
digests are first dealt by their high bits into groups of about GROUP, each
with a sketch of its own, so the work is in proportion to the text. A group
that does not peel empty is sketched again with twice the cells and other hash
bits, up to SIZES[-1]; the digests of a group that fails there too are compared
directly. likeness = common / all paragraph digests of both (1 for two empty
texts).

Next documents: rows are ordered by descending id. They move once, to blocks
of BLOCK neighbouring ids; a window finds the next row, and the first text of
each block goes to the block before it.

Cases: null text is empty; null ids come after all others, among themselves in
the order of a text hash; rows of equal id are ordered by text, descending, and
each gets a result; a single row is its own next; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import cut, ordered, table

LINE, SENTENCE = 120, 80
BASE = 4
GROUP = 8
SIZES = (8, 16, 32, 64)
ROUNDS = 12
BLOCK = 32

PARAGRAPHS = f"[^\\n]{{1,{LINE}}}[^\\n.!?]{{0,{SENTENCE}}}[.!?]*\\n*|\\n+"


def _digests(text: str) -> str:
    """SQL: the text's paragraph digests, ascending, with repetitions."""
    pattern = PARAGRAPHS.replace("\\", "\\\\")
    return f"sort_array(transform(regexp_extract_all({text}, '{pattern}', 0), p -> xxhash64(p)))"


def _starts(array: str, key: str = "{0}") -> str:
    """SQL: the places where a run of equal keys begins in a sorted array."""
    here, before = key.format(f"get({array}, i)"), key.format(f"get({array}, i - 1)")
    return f"filter(if(size({array}) > 0, sequence(0, size({array}) - 1), array()), i -> i = 0 or {here} <> {before})"


def _elements(digests: str, starts: str) -> str:
    """SQL: one number per distinct paragraph, from its digest and its occurrences; the two lowest bits are free."""
    return (f"transform({starts}, (p, k) -> xxhash64(get({digests}, p), "
            f"coalesce(get({starts}, k + 1), size({digests})) - p) & -4L)")


def _hit(cell: str, key: str, width: int) -> str:
    """SQL: whether a digest belongs to a cell; parts of ``width`` cells read different bits."""
    bits = width.bit_length() - 1
    return f"(({cell} % {width}) = (shiftright({key}, 8 + {bits} * cast({cell} div {width} as int)) & {width - 1}))"


def _check(key: str) -> str:
    return f"xxhash64({key}, 7)"


def _cells(keys: str, width: int) -> str:
    """SQL: the sketch of an array of digests: array of (n, k, x)."""
    return (f"transform(sequence(0, {3 * width - 1}), i -> aggregate({keys}, named_struct('n', 0, 'k', 0L, 'x', 0L), (c, e) -> "
            f"if({_hit('i', 'e', width)}, named_struct('n', c.n + 1, 'k', c.k ^ e, 'x', c.x ^ {_check('e')}), c)))")


def _peel(cells: str, width: int, result: str, more: str = "") -> str:
    """SQL: peels subtracted cells; ``result`` of the state s if they end up empty, else null. ``s.d`` counts
    the digests; with ``more`` (a column type) ``s.found`` collects them with their side (1: left, -1: right).
    """
    pure = (f"array_distinct(transform(filter(transform(s.cells, (c, i) -> named_struct('n', c.n, 'k', c.k, 'x', c.x, 'i', i)), "
            f"c -> abs(c.n) = 1 and c.x = {_check('c.k')} and {_hit('c.i', 'c.k', width)}), c -> named_struct('n', c.n, 'k', c.k)))")
    taken = (f"transform(s.cells, (c, i) -> aggregate(s.pure, c, (a, p) -> if({_hit('i', 'p.k', width)}, "
             f"named_struct('n', a.n - p.n, 'k', a.k ^ p.k, 'x', a.x ^ {_check('p.k')}), a)))")
    empty = "cast(array() as array<struct<n:int,k:bigint>>)"
    start, same, grown = (f", 'found', cast(array() as {more})", ", 'found', s.found", ", 'found', concat(s.found, s.pure)") if more else ("", "", "")
    # odd steps look for pure cells, even steps take them out; without any, the rest is passed over
    step = (f"case when not s.live then s "
            f"when r % 2 = 1 then named_struct('cells', s.cells, 'pure', {pure}, 'd', s.d, 'live', true{same}) "
            f"when size(s.pure) = 0 then named_struct('cells', s.cells, 'pure', s.pure, 'd', s.d, 'live', false{same}) "
            f"else named_struct('cells', {taken}, 'pure', {empty}, 'd', s.d + size(s.pure), 'live', true{grown}) end")
    return (f"aggregate(sequence(1, {2 * ROUNDS}), named_struct('cells', {cells}, 'pure', {empty}, 'd', 0, 'live', true{start}), (s, r) -> {step}, "
            f"s -> if(exists(s.cells, c -> c.n <> 0 or c.k <> 0L or c.x <> 0L), null, {result}))")


def _subtracted(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'x', a.x ^ b.x))"


def _peeled(left: str, right: str, width: int) -> str:
    """SQL: number of differing digests, or null if the cells do not peel empty."""
    return _peel(_subtracted(_cells(left, width), _cells(right, width)), width, "s.d")


def compare_fingerprints(df: DataFrame, left: str, right: str, width: int = BASE) -> DataFrame:
    """Adds what two stored fingerprints (as ``with_sketches`` writes them) tell about each other: ``only_left`` and
    ``only_right``, the recovered digests of the differing paragraphs, and ``likeness``.

    All three are null where the sketches hold more differences than their cells can give back (about 3 * width / 1.3):
    then larger sketches are needed, which ``with_likeness`` makes from the texts, or fingerprints of a larger width.
    """
    def cells(c: str) -> str:
        number = "cast(conv({}, 16, -10) as bigint)".format
        part = "split(c, ':')"
        return (f"transform(split(substring_index(`{c}`, ';', -1), ','), c -> named_struct('n', cast(get({part}, 0) as int), "
                f"'k', {number(f'get({part}, 1)')}, 'x', {number(f'get({part}, 2)')}))")

    found = _peel(_subtracted("_left", "_right"), width, "s.found", "array<struct<n:int,k:bigint>>")
    df = df.withColumns({"_left": F.expr(cells(left)), "_right": F.expr(cells(right))}).withColumn("_found", F.expr(found))
    for name, side in (("only_left", 1), ("only_right", -1)):
        df = df.withColumn(name, F.expr(f"sort_array(transform(filter(_found, p -> p.n = {side}), p -> p.k))"))
    total = sum((F.substring_index(c, ";", 1).cast("int") for c in (left, right)), F.lit(0))
    d = F.size("_found")
    likeness = F.when(F.col("_found").isNotNull(), F.when(total == 0, F.lit(1.0)).otherwise((total - d).cast("double") / (total + d)))
    return df.withColumn("likeness", likeness).drop("_left", "_right", "_found")


def _difference(group: str, other: int) -> str:
    """SQL: differing digests between side 0 and side ``other`` of a group of marked digests."""
    def side(n: int) -> str:
        return f"transform(filter({group}, e -> (e & 3L) = {n}L), e -> e & -4L)"

    a, b = side(0), side(other)
    return f"coalesce({', '.join(_peeled(a, b, w) for w in SIZES)}, size(array_except({a}, {b})) + size(array_except({b}, {a})))"


def with_sketches(df: DataFrame, texts: list[str], width: int = BASE) -> DataFrame:
    """Adds ``_e_<text>`` (distinct paragraph digests) and ``_f_<text>`` (fingerprint of 3 * ``width`` cells, a power of two) for text columns without nulls."""
    df = df.withColumns({f"_d_{t}": F.expr(_digests(t)) for t in texts})
    df = df.withColumns({f"_r_{t}": F.expr(_starts(f"_d_{t}")) for t in texts})
    df = df.withColumns({f"_e_{t}": F.expr(_elements(f"_d_{t}", f"_r_{t}")) for t in texts})
    shown = "c -> concat(c.n, ':', lpad(hex(c.k), 16, '0'), ':', lpad(hex(c.x), 16, '0'))"
    return df.withColumns({
        f"_f_{t}": F.expr(f"concat(size(_e_{t}), ';', array_join(transform({_cells(f'_e_{t}', width)}, {shown}), ','))") for t in texts
    }).drop(*[f"_{x}_{t}" for t in texts for x in "dr"])


def with_likeness(df: DataFrame, left: str, others: dict[str, str]) -> DataFrame:
    """Adds the likeness of ``left`` to each of the (at most three) other texts, {text: new column}; needs ``with_sketches``."""
    names = [left, *others]
    marked = ", ".join(f"transform(_e_{t}, e -> e | {n}L)" for n, t in enumerate(names))
    df = df.withColumn("_all", F.expr(f"sort_array(concat({marked}))"))
    # the number of groups follows the largest difference that is possible
    most = F.greatest(*[F.size(f"_e_{t}") for t in others], F.lit(0)) + F.size(f"_e_{left}")
    df = df.withColumn("_groups", F.greatest(F.lit(1), F.ceil(most / GROUP)).cast("long"))
    df = df.withColumn("_runs", F.expr(_starts("_all", "shiftright((shiftrightunsigned({0}, 40) * _groups), 24)")))
    df = df.withColumn("_split", F.expr("transform(_runs, (p, k) -> slice(_all, p + 1, coalesce(get(_runs, k + 1), size(_all)) - p))"))
    pairs = ", ".join(f"'d{n}', {_difference('g', n)}" for n in range(1, len(names)))
    df = df.withColumn("_diff", F.expr(f"transform(_split, g -> named_struct({pairs}))"))
    for n, (t, out) in enumerate(others.items(), 1):
        total = F.size(f"_e_{left}") + F.size(f"_e_{t}")
        d = F.expr(f"aggregate(_diff, 0L, (a, x) -> a + x.d{n})")
        df = df.withColumn(out, F.when(total == 0, F.lit(1.0)).otherwise((total - d).cast("double") / (total + d)))
    return df.drop("_all", "_groups", "_runs", "_split", "_diff")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``following``, the next document's text in descending order of doc_id (after the last: the first's)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    block = ["_b", "_h"]
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-(1 << 62))))
    rows = rows.withColumn("_h", F.when(F.col("doc_id").isNull(), F.xxhash64("text").bitwiseAND(1023)).otherwise(0))
    w = Window.partitionBy(*block).orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    placed = rows.withColumns({"_n": F.row_number().over(w), "following": F.lead("text").over(w)})
    # one narrow row per block, in order; each block's first text goes to the block before it
    names = ordered(rows.select(*block).distinct(), [F.desc("_b"), F.desc("_h")]).select(*block, "_rank")
    names = cut(names)
    before = names.select(F.col("_b").alias("_to_b"), F.col("_h").alias("_to_h"), ((F.col("_rank") + 1) % F.lit(max(1, names.count()))).alias("_rank"))
    to = names.join(before, "_rank").drop("_rank")
    heads = placed.filter("_n = 1").select(*block, F.col("text").alias("_head")).join(to, block)
    heads = heads.select(F.col("_to_b").alias("_b"), F.col("_to_h").alias("_h"), "_head")
    return placed.join(heads, block, "left").select("doc_id", "text", F.coalesce("following", "_head").alias("following"))


def compare_versions(docs: DataFrame) -> DataFrame:
    """The registered result: every text against its edited version and against the next document."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("following", F.lit(1), half)))
    rows = with_likeness(with_sketches(rows, ["text", "edited", "following"]), "text", {"edited": "near_edited", "following": "near_next"})
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       F.col("_f_text").alias("fingerprint"), F.col("_f_edited").alias("edited_fingerprint"), "near_edited", "near_next")


def op1_fingerprints(spark, sf_dir):
    return compare_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
