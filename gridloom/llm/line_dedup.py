"""Fuzzy line deduplication with DataFrame operations only.

A line's normal form is its words (runs of letters and digits), lower-cased. Lines of equal normal form
are merged first, by 128 bits of hashes. Candidates share a block of words; pairs are verified by edit
similarity over words; connected lines form a class, of which the first occurrence stays.

Blocks by pigeonhole: with at most a fifth of the longer line's words edited, e = n // 5 edits leave
e + 1 unedited runs. Lines of up to nine words allow one edit, so of two similar ones the first or the
last half agrees; halves lose no pair. Longer lines are known by runs of three words: those that begin
at the first places of the ``KEPT`` words with the least hashes, all words' if there are up to twelve. Two
lines share most of their least words, and a run unless the words behind are edited. Of similar lines
with edits as evenly spread as can be, about 1 % share no run; with edits at random places, 0.1 %.
Blocks of a SimHash can't do this: an edited word in five flips about 13 of 64 bits.

Before texts are read again, pairs go whose lengths or signatures are too far apart. A signature has a bit
for each of a line's 64 least words, of 128: an edit changes two at most in lines of up to 64 words; of
similar lines of 70 to 800 words, none of 1,500 trials each differed in more than 32 bits.

The lines of a block of up to ``SMALL`` are all compared. Of one of up to ``HOT``, lines without a partner by
length and signature go at once. Of larger ones than ``SMALL``, those next to each other in the order of their signatures, and each with the first and last, are verified first; that joins up most of a
dense group of near copies. Only lines still in different classes are then
joined with one another, so a group of n near copies doesn't make n * n pairs. Larger blocks are dealt by
length and, beyond ``HOT`` lines, to a grid of cells, so no task has more than that of one block. Lines
that have no partner of another class there go first, without their words; the cells of the others
are worked off in rounds, so that what is shuffled for them stays in proportion to the lines. Before pairs
are compared there, their words are counted in bags, which tells long lines of the same few words apart.

Rows are numbered once, in a cut table. Numbers are shuffled to find candidates; texts only of candidates,
and once to rebuild documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.plans.components import connected_components
from gridloom.plans.lineage import cut, discard, keep, scratch

SIMILARITY = 0.8
#: Runs of three words that a line is known by, at most (but for lines of up to two words more).
KEPT = 10
#: Lines of a block that meet in one cell of its grid.
HOT = 4000
#: Lines of a block that are all compared at once.
SMALL = 16
#: Lines of a block beyond which they are dealt by length, too.
STEPPED = 256
#: Lines shuffled in a round of cells, at least.
ROUND = 500_000
_HALVED = 9  # words of lines that allow one edit at most
_NEIGHBOURS = 3
_SIGNED = 64  # words of a signature
_BITS = 32  # that signatures of similar lines of more words may differ in
_BAGS = tuple(f"bag{k}" for k in range(16))  # by hash, in which a line's words are counted
_LETTERS = 20_000  # of words by hash
_FRESH = 1_000  # for words that share one of these
_WORDS = r"[^a-z0-9\p{L}\p{N}]+"


def _materialised(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once per row, however often later expressions use them."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def line_words(line: Column) -> Column:
    """The words of a line's normal form."""
    return F.array_remove(F.split(F.lower(line), _WORDS), "")


def _hashed(lines: DataFrame) -> DataFrame:
    """lines with h, the hashes of their words, instead of their text; only those with a word."""
    worded = _materialised(lines, words=line_words(F.col("line"))).drop("line").where(F.size("words") > 0)
    return _materialised(worded, h=F.transform("words", lambda w: F.xxhash64(w))).drop("words")


def _lines(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, row, pos, line) of all lines."""
    return rows.select(F.col(f"`{doc}`").alias("doc"), F.col("__row").alias("row"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"))


def distinct_lines(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """(k1, k2: hashes of the normal form, n: its words, sig0, sig1: signature, blocks, at) of every normal form with a word.

    at is its first place (doc, row, pos), null ids first.
    """
    n, h = F.col("n"), F.col("h")
    of = _hashed(_lines(rows, doc, text)).select("doc", "row", "pos", F.size("h").alias("n"), F.xxhash64("h").alias("k1"), F.xxhash64(F.lit(7), "h").alias("k2"), "h")
    known = F.slice(F.sort_array(F.array_distinct("h")), 1, _SIGNED)
    of = _materialised(of, known=known)
    most = F.when(n < _HALVED - 1, 0).when(n <= KEPT + 2, n).otherwise(KEPT)  # lines of 8 and 9 words meet those of 10
    # place by place, not by a lambda: Spark compiles these and interprets that
    of = _materialised(of, places=F.array(*[F.when(most > k, F.array_position("h", F.get("known", F.lit(k))).cast("int")) for k in range(KEPT + 2)]))

    def sig(half: int) -> Column:  # bits of the words whose hash has bit 6 so
        bit = lambda x: F.when(x.bitwiseAND(F.lit(64)) == 64 * half, F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.aggregate("known", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x))).alias(f"sig{half}")

    run = lambda i: F.when(i + 1 < n, F.xxhash64(F.get(h, i - 1), F.get(h, i), F.get(h, i + 1)).bitwiseAND(F.lit(-2)))  # noqa: E731  (even)
    runs = F.array(*[run(F.get("places", F.lit(k))) for k in range(KEPT + 2)])
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.greatest(F.floor((n - 1) / 2).cast("int"), F.lit(2))))
    halves = F.flatten(F.transform(sizes, lambda m: F.array(F.xxhash64(F.lit("first"), F.slice(h, 1, m)), F.xxhash64(F.lit("last"), F.slice(h, n - m + 1, m)))))
    halves = F.transform(halves, lambda x: x.bitwiseOR(F.lit(1)))
    blocks = F.array_distinct(F.array_compact(F.when((n > 3) & (n <= _HALVED), F.concat(runs, halves)).otherwise(runs)))
    first = of.select("doc", "row", "pos", "n", "k1", "k2", sig(0), sig(1), blocks.alias("blocks")).groupBy("k1", "k2").agg(F.min(F.struct("doc", "row", "pos", "n", "sig0", "sig1", "blocks")).alias("at"))
    return first.select("k1", "k2", "at.n", "at.sig0", "at.sig1", "at.blocks", F.struct("at.doc", "at.row", "at.pos").alias("at"))


def shared_blocks(lines: DataFrame) -> DataFrame:
    """(block, k1, n, sig0, sig1, size) for the blocks of two lines or more; size is the block's number of lines."""
    one = lines.select(F.explode("blocks").alias("block"), *_FACTS)
    sizes = cut(one.groupBy("block").agg(F.count("*").alias("size")).where("size > 1"), "line-sizes")
    return _probed(one, ["block"], sizes).join(sizes, "block")


def _probed(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """rows whose keys may be among wanted's, found as they are read, so that few others are shuffled.

    A bitmap of 2^26 bits is sent, as at most 2^11 arrays of 4 KB: 8 MB whatever the tables' sizes.
    Beyond some 10^8 wanted keys it lets everything pass; an exact join always follows.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << 26))
    marks = wanted.select(spot.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("cell")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits"))
    marks = marks.select("cell", F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) as bigint))").alias("bits"))  # 8 bytes each
    at = rows.withColumn("h", spot).withColumns({"cell": F.expr("bitmap_bucket_number(h)"), "bit": F.expr("cast(bitmap_bit_position(h) as int)")})
    held = F.expr("shiftrightunsigned(get(bits, bit div 64), 56 - 8 * ((bit % 64) div 8) + bit % 8) & 1 = 1")  # bit % 8 of byte bit div 8
    return at.join(F.broadcast(marks), "cell").where(held).select(*rows.columns)


def wanted_words(rows: DataFrame, doc: str, text: str, wanted: DataFrame) -> DataFrame:
    """(k1, h: the words' hashes) of the lines wanted, a table of (k1, row, pos)."""
    found = _probed(_lines(rows, doc, text).drop("doc"), ["row", "pos"], wanted.select("row", "pos")).join(wanted, ["row", "pos"])
    return _hashed(found.select("k1", "line"))


_FACTS = ("k1", "n", "sig0", "sig1")


def _most(a: Column, b: Column, similarity: float) -> Column:
    """The edits that two lines of a and b words may be apart."""
    return F.floor(F.greatest(a, b) * (1 - similarity) + 1e-9).cast("int")


def _may(a: str, b: str, similarity: float, block: Column | None = None) -> Column:
    """Whether lengths and signatures allow two lines of a block to be similar."""
    block = F.col("block") if block is None else block
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    most = _most(n, m, similarity)
    apart = sum((F.bit_count(F.col(f"{a}sig{k}").bitwiseXOR(F.col(f"{b}sig{k}"))) for k in range(2)), F.lit(0))
    met = (F.greatest(n, m) > _HALVED) | (block.bitwiseAND(F.lit(1)) == 1)  # two short lines share a half if they are similar
    return met & (F.abs(n - m) <= most) & (apart <= F.when(F.greatest(n, m) <= _SIGNED, 2 * most).otherwise(_BITS))


def _parts() -> Column:
    """By how many cells a side a block's grid has."""
    return F.ceil(F.col("size") / HOT).cast("int")


def _together(blocks: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all lines of small blocks that may be similar."""
    a, b = (blocks.select("block", *[F.col(c).alias(f"{side}_{c}") for c in _FACTS]) for side in "ab")
    met = a.join(b, "block").where((F.col("a_k1") < F.col("b_k1")) & _may("a_", "b_", similarity))
    return met.select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b"))


def _neighbours(blocks: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of lines that may be similar: each with the three before it, the first and the last in a block's order of signatures."""
    order = Window.partitionBy("block", F.when(_parts() > 1, F.pmod(F.xxhash64("sig0"), _parts()))).orderBy("sig0", "sig1", "k1")
    facts = F.struct(*_FACTS)
    met = {f"l{k}": F.lag(facts, k).over(order) for k in range(1, _NEIGHBOURS + 1)}
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met |= {"first": F.first(facts).over(whole), "last": F.last(facts).over(whole)}  # copies of one line are similar to most of the others
    rows = blocks.select("block", *_FACTS, *[c.alias(name) for name, c in met.items()])
    before = rows.select("block", *_FACTS, F.explode(F.array(*met)).alias("l")).where(F.col("l").isNotNull() & (F.col("l.k1") != F.col("k1")) & _may("", "l.", similarity))
    return before.select(F.least("k1", "l.k1").alias("a"), F.greatest("k1", "l.k1").alias("b"))


def _dealt(blocks: DataFrame) -> DataFrame:
    """blocks with part, and low and high, the parts that its lines meet: ``low`` to ``part`` and ``part`` to ``high``.

    The parts of a block are numbered by the length of their lines, in steps of 1.25, and by hash within a
    step: similar lines are of one step or of two that follow each other. Smaller blocks have a single step.
    """
    step = F.when(F.col("size") > STEPPED, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / SIMILARITY)))).otherwise(0).cast("int")
    whole = F.col("size") <= min(STEPPED, HOT)
    rows = blocks.where(~whole).withColumn("step", step)
    upto = lambda last: F.coalesce(F.sum("parts").over(Window.partitionBy("block").orderBy("step").rangeBetween(Window.unboundedPreceding, last)), F.lit(0)).cast("int")
    steps = rows.groupBy("block", "step").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    steps = steps.select("block", "step", "parts", upto(-1).alias("start"), upto(-2).alias("low"), (upto(1) - 1).alias("high"))
    dealt = rows.join(steps, ["block", "step"]).withColumn("part", F.col("start") + F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int"))
    places = [*blocks.columns, "part", "low", "high"]
    return dealt.select(places).union(blocks.where(whole).select("*", *[F.lit(0).alias(c) for c in places[-3:]]))


def _partnered(dealt: DataFrame, similarity: float) -> DataFrame:
    """(block, facts, size, root) of those lines of dealt blocks that have one of another root in their block which may be similar.

    Lengths and signatures tell, without words, and a line is done at its first partner. So a passage that
    otherwise different lines share brings no line further, and a dense block makes rows by its lines, not its pairs.
    """
    facts = (*_FACTS, "root")
    one = dealt.select("block", "size", *[F.col(c).alias(f"a_{c}") for c in facts], F.explode(F.sequence("low", "high")).alias("part"))
    other = dealt.select("block", "part", *[F.col(c).alias(f"b_{c}") for c in facts])
    may = (one["block"] == other["block"]) & (one["part"] == other["part"]) & (F.col("a_root") != F.col("b_root")) & _may("a_", "b_", similarity, one["block"])
    return one.join(other, may, "left_semi").select("block", *[F.col(f"a_{c}").alias(c) for c in facts], "size").distinct()


def _across(blocks: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b, most) of all lines that share one of the blocks, are near and have different roots.

    blocks has (block, facts, size, root), words (k1, h, form). Every two parts of a block whose lines may be
    similar meet in a cell. Pairs are verified where they meet, in the first of these blocks that they share,
    so those that aren't near are never written. What is shuffled for the cells grows faster than the lines
    where blocks have many parts; so cells are worked off in rounds of about ``ROUND`` lines, or half as many as there are, each.
    """
    places = F.collect_list(F.struct("block", "part", "low", "high")).alias("places")
    lines = _dealt(blocks).groupBy("k1").agg(*[F.first(c).alias(c) for c in (*_FACTS[1:], "root")], places)
    wanted = words.join(blocks.select("k1").distinct(), "k1", "left_semi")
    bag = [F.count_if(F.pmod("w", F.lit(len(_BAGS))) == k).cast("int").alias(c) for k, c in enumerate(_BAGS)]
    bags = wanted.select("k1", F.explode("h").alias("w")).groupBy("k1").agg(*bag)
    lines = cut(lines.join(bags, "k1").join(wanted.select("k1", "form"), "k1"), "line-meeting")
    met = F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + x["high"] - x["low"] + 2)
    size = lines.agg(F.sum(met).alias("met"), F.count("*").alias("lines")).first()
    rounds = -(-(size["met"] or 0) // max(ROUND, size["lines"] // 2))
    found = [cut(_cells(lines, k, rounds, similarity), "line-near") for k in range(max(1, rounds))]
    discard(lines)
    return reduce(DataFrame.union, found)


def _cells(lines: DataFrame, k: int, rounds: int, similarity: float) -> DataFrame:
    """_across for round k of so many."""
    rows = lines.withColumn("blocks", F.col("places.block")).withColumn("place", F.explode("places")).select("*", "place.*")
    facts = (*_FACTS, "root", "blocks", "form", *_BAGS)
    here = lambda i, j: F.pmod(F.xxhash64(F.col("block"), i, j), F.lit(max(1, rounds))) == k
    after = F.filter(F.sequence("part", "high"), lambda j: here(F.col("part"), j))  # other rounds' cells make no rows
    before = F.filter(F.sequence("low", "part"), lambda i: here(i, F.col("part")))
    own = rows.select("block", F.col("part").alias("i"), F.explode(after).alias("j"), *[F.col(c).alias(f"a_{c}") for c in facts])
    met = rows.select("block", F.explode(before).alias("i"), F.col("part").alias("j"), *[F.col(c).alias(f"b_{c}") for c in facts])
    once = ((F.col("i") < F.col("j")) | (F.col("a_k1") < F.col("b_k1"))) & (F.col("a_root") != F.col("b_root"))
    half = F.when(F.greatest("a_n", "b_n") <= _HALVED, 1).otherwise(0)  # the blocks that _may admits
    first = F.array_min(F.filter(F.array_intersect("a_blocks", "b_blocks"), lambda x: x.bitwiseAND(F.lit(1)) == half)) == F.col("block")
    most = _most(F.col("a_n"), F.col("b_n"), similarity)
    near = F.call_function("levenshtein", F.col("a_form"), F.col("b_form"), most) >= 0
    both = own.join(met, ["block", "i", "j"]).where(once & _may("a_", "b_", similarity) & _bags_allow("a_", "b_", most) & first & near)
    return both.select(F.least("a_k1", "b_k1").alias("a"), F.greatest("a_k1", "b_k1").alias("b"), most.alias("most"))


def _bags_allow(a: str, b: str, most: Column) -> Column:
    """Whether the numbers of two lines' words in each bag are within ``most`` edits. An edit takes a word from one bag at most, and adds one to one at most."""
    apart = sum((F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in _BAGS), F.lit(0))
    return apart + F.abs(F.col(f"{a}n") - F.col(f"{b}n")) <= 2 * most


def _string(letters: Column) -> Column:
    """A string with one character per number of an array, from 0 to ``_LETTERS + _FRESH`` - 1, out of a constant."""
    alphabet = F.split(F.lit("".join(chr(0x4E00 + k) for k in range(_LETTERS + _FRESH))), "")
    return F.array_join(F.transform(letters, lambda x: F.get(alphabet, x.cast("int"))), "")


def words_of(keys: DataFrame, rows: DataFrame, lines: DataFrame, doc: str, text: str) -> DataFrame:
    """(k1, h, form: a string with a character per word) of the lines of keys (k1)."""
    wanted = cut(lines.select("k1", "at.row", "at.pos").join(keys, "k1", "left_semi"), "line-wanted")
    words = wanted_words(rows, doc, text, wanted).select("k1", "h", _string(F.transform("h", lambda x: F.pmod(x, F.lit(_LETTERS)))).alias("form"))
    return cut(words, "line-words")


def near_pairs(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b, most) of the pairs (a, b) whose lines (k1, form) are at most ``most`` edits apart."""
    side = lambda c: words.select(F.col("k1").alias(c), F.col("form").alias(f"form{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("most", _most(F.char_length("forma"), F.char_length("formb"), similarity))
    near = both.where(F.expr("levenshtein(forma, formb, most)") >= 0)  # stops beyond the threshold, with -1
    return near.select("a", "b", "most")


def similar(near: DataFrame, words: DataFrame) -> DataFrame:
    """(src, dst) of those near pairs (a, b, most) whose lines (k1, h) are at most ``most`` edits apart, an edit being a word.

    The distance of near pairs is taken between strings with a character per word, its hash modulo ``_LETTERS``.
    That can only be too small, where two different words of the pair have one character; such pairs are
    compared again with other characters for such words, or, where these don't suffice, for all.
    """
    near = cut(near, "line-near")
    side = lambda c: words.select(F.col("k1").alias(c), F.col("h").alias(f"h{c}"))
    near = _materialised(near.join(side("a"), "a").join(side("b"), "b"), known=F.array_union("ha", "hb"))
    letter = lambda x: F.pmod(x, F.lit(_LETTERS)).cast("int")
    told_apart = F.size(F.array_distinct(F.transform("known", letter))) == F.size("known")
    near = _materialised(near, ranked=F.when(~told_apart, F.sort_array(F.transform("known", lambda x: F.struct(letter(x).alias("l"), x.alias("x"))))))
    beside = lambda s, i: F.coalesce(F.get("ranked", i - 1)["l"] == s["l"], F.lit(False)) | F.coalesce(F.get("ranked", i + 1)["l"] == s["l"], F.lit(False))
    near = _materialised(near, shared=F.filter("ranked", beside)["x"])  # words that share a character
    fresh = lambda h: F.transform(F.col(h), lambda x: F.when(F.array_contains("shared", x), _LETTERS - 1 + F.array_position("shared", x)).otherwise(letter(x)))
    place = lambda h: F.transform(F.col(h), lambda x: F.array_position("known", x) - 1)
    told = lambda h: _string(F.when(F.size("shared") <= _FRESH, fresh(h)).otherwise(place(h)))
    exact = F.when(F.col("shared").isNull() | ((F.size("shared") > _FRESH) & (F.size("known") > _LETTERS)), F.lit(True)).otherwise(F.call_function("levenshtein", told("ha"), told("hb"), F.col("most")) >= 0)
    return near.where(exact).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def kept_places(rows: DataFrame, doc: str, text: str, similarity: float) -> DataFrame:
    """(__of: row, __stay: line numbers) of the lines that are the first of their class."""
    lines = cut(distinct_lines(rows, doc, text), "line-distinct")
    shared = cut(shared_blocks(lines), "line-blocks")
    small, large = shared.where(F.col("size") <= SMALL), shared.where(F.col("size") > SMALL)
    # lines without a partner go at once; in blocks beyond ``HOT`` once neighbours are joined up, as a grid of all would be large
    alone = cut(_dealt(large.where(F.col("size") <= HOT).withColumn("root", F.col("k1"))), "line-dealt")
    partnered = cut(_partnered(alone, similarity).drop("root"), "line-partnered")
    discard(alone)
    large = partnered.union(large.where(F.col("size") > HOT).select(partnered.columns))
    close = _together(small, similarity).union(_neighbours(large, similarity)).distinct()
    close = cut(close, "line-pairs")
    first = cut(lines.select("k1", "k2", "at"), "line-first")
    discard(lines)  # most of it is blocks, which nothing reads from here on
    lines = first
    words = words_of(close.select(F.col("a").alias("k1")).union(close.select("b")).union(partnered.select("k1")).distinct(), rows, lines, doc, text)
    near = connected_components(similar(near_pairs(close, words, similarity), words))
    # what is left: blocks that hold several classes
    rooted = large.join(near.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    mixed = rooted.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("block")
    dealt = cut(_dealt(rooted.join(mixed, "block", "left_semi")), "line-mixed")
    discard(shared)
    rooted = cut(_partnered(dealt, similarity), "line-partnered")
    discard(dealt)
    missing = cut(rooted.select("k1").distinct().join(words.select("k1"), "k1", "left_anti"), "line-missing")
    if not missing.isEmpty():  # lines of blocks beyond ``HOT``
        words = words.union(words_of(missing, rows, lines, doc, text))
    across = cut(_across(rooted, words, similarity), "line-across")
    discard(rooted)
    met = across.select(F.col("a").alias("k1")).union(across.select("b")).distinct()
    across = similar(across, words.join(met, "k1", "left_semi"))  # mostly few, so that few words are shuffled
    to_root = lambda end: near.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = across.join(to_root("src"), "src", "left").join(to_root("dst"), "dst", "left").select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst"))
    classes = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("class"))  # of roots, and of lines that had no class
    linked = near.select(F.col("node").alias("k1"), "root").join(classes, "root", "left").select("k1", F.coalesce("class", "root").alias("class"))
    classed = lines.select("k1", "at").join(linked.union(classes.join(linked, F.col("root") == F.col("k1"), "left_anti")), "k1", "left")
    # a line without a link is the first of its own, known by all 128 bits; those of linked ones differ in 64
    first = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("at").alias("at")).select("at").union(classed.where("class IS NULL").select("at"))
    return keep(cut(first.groupBy(F.col("at.row").alias("__of")).agg(F.collect_set("at.pos").alias("__stay")), "line-kept"))


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """df with its text rid of repeated lines, and with n_lines_kept and n_lines_removed.

    Of every class of alike lines the first occurrence stays, in the document with the smallest id
    (null ids first), in its first place. Lines without a letter or digit stay. A null text stays null,
    an empty one empty; a document may end up empty. Rows that share an id, or are the same, are
    documents of their own, in the order of a number given to the rows once. An empty table gives no
    rows. Other columns are kept as they are, but for those of the two new names. Lines have any length;
    where a pair has over 20,000 different words, two of them can pass for one.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"blocks are shared from a similarity of {SIMILARITY} on")
    columns = [c for c in df.columns if c.lower() not in ("n_lines_kept", "n_lines_removed")]
    with scratch():
        rows = keep(cut(df.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("__row")), "line-rows"))
        stay = kept_places(rows, doc, text, similarity)
    joined = rows.join(stay.hint("shuffle_hash"), F.col("__row") == F.col("__of"), "left")
    joined = _materialised(joined, __lines=F.split(F.col(f"`{text}`"), "\n"))
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    worded = F.filter(places, lambda k: F.get(F.col("__lines"), k).rlike(r"[a-z0-9\p{L}\p{N}]"))
    joined = _materialised(joined, __gone=F.array_except(worded, F.coalesce("__stay", F.array().cast("array<int>"))))  # by hash sets, also where documents have very many lines
    lost = F.coalesce(F.size("__gone"), F.lit(0))
    left = F.transform(F.array_except(places, F.col("__gone")), lambda k: F.get(F.col("__lines"), k))
    body = F.when(lost > 0, F.array_join(left, "\n")).otherwise(F.col(f"`{text}`"))
    return joined.select(
        *[(body if c == text else F.col(f"`{c}`")).alias(c) for c in columns],
        (F.coalesce(F.size("__lines"), F.lit(0)) - lost).cast("long").alias("n_lines_kept"), lost.cast("long").alias("n_lines_removed"),
    )
