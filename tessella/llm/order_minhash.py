"""Order MinHash fingerprints, by DataFrame functions only.

A text is cut into pieces, all of one kind: PIECE characters at each offset of a word (run of anything but ASCII white
space; a shorter word is one piece), and each run of white space but single spaces. So a character more or less changes
the few pieces round it, however long the word and however many words there are. K successive pieces make a k-mer (fewer
pieces: all of them; none: no k-mer). Equal k-mers are numbered by occurrence, so a text is a set of elements (k-mer,
number).

Each of BINS signatures has one random order of all elements. The two smallest elements of the text under that order are
selected, brought into their order in the text, and the pair is hashed. Two texts agree in a signature if they select
the same pair and have it in the same order, which a change of order undoes as well as a change of content, so the share
of equal signatures falls with edit distance.

The orders come from one pass, as in one-permutation hashing: in each of several rounds an element falls by a hash into
one bin with a rank, and the order of a bin is (first round in which an element falls there, rank). rounds() is the
number of rounds that fill every bin, one for long texts and hundreds for three elements; ranks that can't be among the
two smallest of a bin are left out. Either holds but with a probability of about e^-CERTAIN a signature; such a signature
has the elements that it got, and depends on the text alone like any other.

Plan: everything about a text is array expressions of its row; nothing is exploded, aggregated or shuffled for it.

Defined results: a null text is empty; texts without k-mers have the fingerprint of the empty text, those with one or two
elements select all of them; equal texts have equal fingerprints; repeated rows are rows of their own; a null id counts
as the smallest; rows that share an id are in the order of a hash of their texts; an empty table gives an empty result;
other columns pass by. Hashes of k-mers and of elements have 33 bits, positions 31, as many as an array can have.
"""

from __future__ import annotations

from collections import Counter

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import unclashed

#: Signatures of a fingerprint, pieces of a k-mer, characters of a piece.
BINS, K, PIECE = 64, 2, 8
_WHITE, _BLACK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Bits of a position, in a text or an array, at the low end of a long, and of a bin at its high end.
POSITION, BIN = 31, 6
LOW, HIGH = (1 << POSITION) - 1, ~((1 << POSITION) - 1)
#: Ranks have 27 bits between those: in round 0 a zero and 26 bits, later a one, ten bits of the round and 16 bits.
RANK, LATER, ROUND = 26, 1 << 57, 47
CERTAIN = 11.5
#: Quantiles of the ids are exact to this share of a range.
ACCURACY = 10


def _long(x: int) -> Column:
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def pieces(text: Column, piece: int = PIECE) -> Column:
    """Array of a text's pieces."""
    word = rf"(?<!{_BLACK}){_BLACK}{{1,{piece}}}+(?!{_BLACK})"
    space = rf"(?:{_WHITE}{{2,}}+|[\x09-\x0D])"
    return F.regexp_extract_all(text, F.lit(rf"(?=({word}|{_BLACK}{{{piece}}}|{space}))(?:{word}|{space}|{_BLACK})"), F.lit(1))


def sorted_kmers(p: str, k: int = K) -> Column:
    """Array of the k-mers of the pieces p, each a long of 33 hash bits above its position, sorted: equal k-mers stand together in text order."""
    # hashing ignores nulls, so the k-mers at the end are shorter ones; those that aren't whole are cut off
    packed = F.transform(p, lambda x, i: F.xxhash64(x, *[F.get(p, i + n) for n in range(1, k)]).bitwiseAND(_long(HIGH)).bitwiseOR(i.cast("long")))
    return F.sort_array(F.slice(packed, 1, F.greatest(F.size(p) - (k - 1), F.lit(1))))


def rounds(n: Column) -> Column:
    """Rounds of a text with n > 2 elements: that few of them fall into a bin has a probability of at most (n + 1) e^(-rounds (n - 1) / BINS)."""
    return F.ceil(BINS * (F.log(n + 1.0) + CERTAIN) / (n - 1)).cast("int")


def bound(n: Column) -> Column:
    """Ranks of round 0, in place in a long, that are looked at in a text of one round; BINS * c of n elements are below it, c a bin, under two with a probability of (1 + c) e^-c."""
    part = F.least(F.ceil((1 << RANK) * (BINS * (CERTAIN + 3)) / n).cast("long"), F.lit(1 << RANK))
    return F.when(rounds(n) > 1, _long(LATER)).otherwise(part * F.lit(1 << POSITION))


def elements(s: str) -> Column:
    """Array of the elements below the bound, from the sorted k-mers s: 33 hash bits above the position. A first k-mer of its kind keeps its hash; the number of another one, its distance to the first, is hashed in."""
    n = F.greatest(F.size(s), F.lit(1))
    most, top = bound(F.greatest(n, F.lit(3))), F.floor(F.log2(n)).cast("int")
    steps = F.transform(F.sequence(top, F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b))

    def element(x: Column, i: Column) -> Column:
        kmer = x.bitwiseAND(_long(HIGH))
        same = lambda at: F.get(s, at) >= kmer  # noqa: E731 - s is sorted
        far = F.aggregate(steps, F.lit(2), lambda acc, step: F.when((i - acc >= step) & same(i - acc - step), acc + step).otherwise(acc))
        number = F.when(same(i - 2), F.when(same(i - 3), far).otherwise(F.lit(2))).otherwise(F.lit(1))
        mixed = F.xxhash64(kmer, number).bitwiseAND(_long(HIGH)).bitwiseOR(x.bitwiseAND(_long(LOW)))
        return F.when(same(i - 1), mixed).when(x.bitwiseAND(_long(LATER - 1)) < most, x)

    found = F.filter(F.transform(s, element), lambda x: x.bitwiseAND(_long(LATER - 1)) < most)
    return F.when((n <= 2) | (rounds(F.greatest(n, F.lit(3))) > 1), F.transform(s, lambda x, i: F.coalesce(element(x, i), x))).otherwise(found)


def ranked(e: str, n: str) -> Column:
    """Sorted array of longs (bin, round and rank, index in e), the two smallest elements of each bin among them; n: the number of elements."""
    first = F.transform(e, lambda x, i: x.bitwiseAND(_long(HIGH & ~LATER)).bitwiseOR(i.cast("long")))

    def later(r: Column) -> Column:
        marked = _long(LATER).bitwiseOR(F.shiftleft(r.cast("long"), ROUND))
        kept = _long((~((1 << 58) - 1)) | (0xFFFF << POSITION))
        return F.transform(e, lambda x, i: F.xxhash64(F.shiftrightunsigned(x, POSITION), r).bitwiseAND(kept).bitwiseOR(marked).bitwiseOR(i.cast("long")))

    last = rounds(F.greatest(F.col(n), F.lit(3))) - 1
    more = F.flatten(F.transform(F.sequence(F.lit(1), last), later))
    return F.when(F.col(n) <= 2, F.array().cast("array<long>")).when(last > 0, F.sort_array(F.concat(first, more))).otherwise(F.sort_array(first))


def signatures(e: str, z: str, n: str) -> Column:
    """Array of BINS longs: for each bin the hash of its two smallest elements in text order."""
    hashed = lambda b, x, y: F.xxhash64(b, F.shiftrightunsigned(x, POSITION), F.shiftrightunsigned(y, POSITION))
    low = lambda x: x.bitwiseAND(_long(LOW))
    bin_of = lambda y: F.shiftrightunsigned(y, 64 - BIN)

    def ordered(b: Column, x: Column, y: Column) -> Column:
        """Of x alone if y is null."""
        return F.when(low(y) < low(x), hashed(b, y, x)).otherwise(hashed(b, x, y))

    def of_bin(x: Column, i: Column) -> Column:
        other = lambda y: (bin_of(y) == bin_of(x)) & (low(y) != low(x))
        # in later rounds an element may come again before the second one does
        second = F.when(other(F.get(z, i + 1)), F.get(z, i + 1)).otherwise(F.get(F.filter(F.slice(z, i + 2, F.lit(BINS)), other), F.lit(0)))
        pair = ordered(bin_of(x), F.get(e, low(x).cast("int")), F.get(e, low(second).cast("int")))
        return F.when(bin_of(F.get(z, i - 1)) == bin_of(x), F.lit(None)).otherwise(pair)

    # bins in the order of signed longs, as in z
    all_bins = F.sequence(_long(-BINS // 2), _long(BINS // 2 - 1))
    whole = F.transform(all_bins, lambda b: ordered(b.bitwiseAND(_long(BINS - 1)), F.get(e, F.lit(0)), F.get(e, F.lit(1))))
    return F.when(F.col(n) <= 2, whole).otherwise(F.filter(F.transform(z, of_bin), lambda x: x.isNotNull()))


def fingerprints(rows: DataFrame, texts: list[str], k: int = K, piece: int = PIECE) -> DataFrame:
    """rows with, in place of each text column t, an array of BINS longs fp_<t>."""
    rest = [c for c in rows.columns if c not in texts]
    each = lambda df, f: df.select(*rest, *[f(f"fp_{t}").alias(f"fp_{t}") for t in texts])
    out = rows.select(*rest, *[pieces(F.coalesce(F.col(t), F.lit("")), piece).alias(f"fp_{t}") for t in texts])
    out = each(out, lambda c: sorted_kmers(c, k))
    out = each(out, lambda c: F.struct(F.size(c).alias("n"), elements(c).alias("e")))
    out = each(out, lambda c: F.struct(f"{c}.n", f"{c}.e", ranked(f"{c}.e", f"{c}.n").alias("z")))
    return each(out, lambda c: signatures(f"{c}.e", f"{c}.z", f"{c}.n"))


def as_hex(fp: Column) -> Column:
    """Fingerprint as text: 8 hex digits for each signature."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(_long((1 << 32) - 1))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures; a signature has its bin hashed in, so equal ones are of one bin."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def _literal(values: list[int]) -> Column:
    """An array of longs as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows (bucket, ghost, order, tie, doc_id, text, next_text): each row with the text of the next one by descending id; after the smallest id comes the largest.

    Rows are dealt to ranges of ids; each range also gets the rows of the greatest key of the range before it
    ("ghosts"), so that a window inside the range sees every predecessor. An id with more rows than a range has is dealt
    to several ranges, by ranges of the hash of the text. What is collected is a bound and a key for each range.
    """
    order = F.coalesce(F.col(id_col).cast("long"), _long(1 << 63))
    text = F.coalesce(F.col(text_col), F.lit(""))
    shares = ",".join(f"{i / buckets:.9f}D" for i in range(1, max(2, buckets)))
    quantiles = docs.select(order.alias("order")).agg(F.expr(f"approx_percentile(order, array({shares}), {max(10_000, ACCURACY * buckets)})").alias("b")).first().b or []
    bounds = [(v, -(1 << 63) + (j << 64) // c if j < c else (1 << 63) - 1) for v, c in sorted(Counter(quantiles).items()) for j in range(1, c + 1)]
    hot = len(bounds) > len(set(quantiles))
    key = [order.alias("order"), (F.xxhash64(text) if hot else _long((1 << 63) - 1)).alias("part")]
    by_id, by_part = _literal([b[0] for b in bounds]), _literal([b[1] for b in bounds])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))]).cast("array<int>")

    def beyond(at: Column) -> Column:
        return (F.get(by_id, at) < F.col("order")) | ((F.get(by_id, at) == F.col("order")) & (F.get(by_part, at) < F.col("part")))

    bucket = F.aggregate(steps, F.lit(0), lambda acc, step: F.when(beyond(acc + step - 1), acc + step).otherwise(acc)) if bounds else F.lit(0)
    largest = {r.bucket: r.largest for r in docs.select(*key).groupBy(bucket.alias("bucket")).agg(F.max(F.struct("order", "part")).alias("largest")).collect()}
    full = sorted(largest)
    after = {b: full[(i + 1) % len(full)] for i, b in enumerate(full)}
    every = range(len(bounds) + 1)
    to = F.get(_literal([after.get(b, -1) for b in every]), F.col("own")).cast("int")
    last = (F.col("order") == F.get(_literal([largest[b].order if b in largest else 0 for b in every]), F.col("own"))) & (F.col("part") == F.get(_literal([largest[b].part if b in largest else 0 for b in every]), F.col("own")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), *key)
    rows = rows.withColumn("own", bucket)
    own, sent = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")), F.struct(to.alias("bucket"), F.lit(True).alias("ghost"))
    dealt = rows.select("doc_id", "order", "tie", "text", F.explode(F.when(last, F.array(own, sent)).otherwise(F.array(own))).alias("b")).select("doc_id", "order", "tie", "text", "b.bucket", "b.ghost")
    return dealt.select("bucket", "ghost", "order", "tie", "doc_id", "text", F.lag("text").over(_in_range()).alias("next_text"))


def _in_range() -> Window:
    return Window.partitionBy("bucket").orderBy(F.col("ghost").desc(), "order", "tie")


def edited_texts(rows: DataFrame) -> DataFrame:
    """Adds n_chars and edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of next_text."""
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), half))
    return rows.withColumn("n_chars", n).withColumn("edited", edited)


def fingerprint_and_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited_texts(with_next(unclashed(docs, id_col, text_col), id_col, text_col, buckets))
    rows = rows.select("bucket", "ghost", "order", "tie", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    fp = fingerprints(rows, ["text", "edited"])
    done = fp.withColumn("fp_next", F.lag("fp_text").over(_in_range())).where("not ghost")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp_text")).alias("fingerprint"), as_hex(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"),
    )
