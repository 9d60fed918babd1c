"""Scalar sequence functions as Column expressions. All of them are null for null input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: two-bit codes A=0 C=1 T=2 G=3, and complements
CODE_LETTERS, CODE_DIGITS = "ACTG", "0123"
BASES, COMPLEMENTS = "ACGT", "TGCA"


def normalize(text: Column, mode: str = "drop") -> Column:
    """DNA letters of a text. drop: only A, C, G, T as they stand; keep_upper: after upper-casing; n_to_a: upper-cased, N kept as A."""
    if mode == "drop":
        return F.regexp_replace(text, "[^ACGT]", "")
    if mode == "keep_upper":
        return F.regexp_replace(F.translate(text, "acgtn", "ACGTN"), "[^ACGT]", "")
    if mode == "n_to_a":
        return F.translate(F.regexp_replace(F.translate(text, "acgtn", "ACGTN"), "[^ACGTN]", ""), "N", "A")
    raise ValueError(mode)


def reverse_complement(s: Column, n_pairs_with_c: bool = False) -> Column:
    """N stays N, or, as packed reads have it, counts as G and becomes C."""
    return F.reverse(F.translate(s, BASES + "N", COMPLEMENTS + ("C" if n_pairs_with_c else "N")))


def is_reverse_complement(a: Column, b: Column) -> Column:
    return b == reverse_complement(a)


def packed_words(s: Column, width: int = 31) -> Column:
    """Array of longs, width bases in each, first base in the highest bits. With 32 bases the highest bit is one of theirs."""
    digits = F.regexp_extract_all(F.translate(s, CODE_LETTERS, CODE_DIGITS), F.lit(f".{{1,{width}}}"), F.lit(0))
    if width <= 31:
        return F.transform(digits, lambda d: F.conv(d, 4, 10).cast("long"))
    halves = lambda d: F.shiftleft(F.conv(F.left(d, F.length(d) - 16), 4, 10).cast("long"), 32).bitwiseOR(F.conv(F.right(d, F.lit(16)), 4, 10).cast("long"))
    return F.transform(digits, lambda d: F.when(F.length(d) > 16, halves(d)).otherwise(F.conv(d, 4, 10).cast("long")))


def packed_hamming(x: Column, y: Column, mask: Column | None = None) -> Column:
    """Bases that differ between two packed words. mask: words with both bits set at the bases that count, for words that are not full."""
    d = x.bitwiseXOR(y)
    d = d if mask is None else d.bitwiseAND(mask)
    return F.bit_count((F.shiftright(d, 1).bitwiseOR(d)).bitwiseAND(F.lit(0x5555555555555555)))


def tail_mask(bases: Column) -> Column:
    """A word whose bits are set at the last bases bases of 31 at most."""
    return F.pow(F.lit(4.0), bases).cast("long") - 1


def packed_reverse_complement(word: Column, bases: Column) -> Column:
    """The packed reverse complement of a word of bases bases (31 at most): pairs turned round by halves, then complemented (codes two apart)."""
    out = word
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        out = F.shiftleft(out.bitwiseAND(F.lit(mask)), shift).bitwiseOR(F.shiftrightunsigned(out, shift).bitwiseAND(F.lit(mask)))
    out = F.shiftleft(out, 32).bitwiseOR(F.shiftrightunsigned(out, 32))
    kept = F.call_function("shiftrightunsigned", out, (F.lit(64) - bases * 2).cast("int"))
    return kept.bitwiseXOR(F.lit(0x2AAAAAAAAAAAAAAA).bitwiseAND(tail_mask(bases)))


def packed_shift(words: Column, bases: int, width: int = 31) -> Column:
    """Packed words moved right by bases bases (fewer than width): zeros come in, what leaves a word enters the next, the last word's end is dropped."""
    low, full = (1 << 2 * bases) - 1, 2 * (width - bases)
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(words, F.lit(1), F.size(words) - 1))
    return F.zip_with(before, words, lambda p, w: F.shiftleft(p.bitwiseAND(F.lit(low)), full).bitwiseOR(F.shiftright(w, 2 * bases)))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of equal length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(first == 0, F.least(F.length(a), F.length(b))).otherwise(first - 1).cast("long")


def spaced(s: Column, period: int, length: int | None = None) -> Column:
    """Every period-th character of s from its start, length of them at most."""
    if period == 1:
        return s if length is None else F.substring(s, 1, length)
    # one character and up to period - 1 skipped ones at a time
    kept = F.regexp_replace(s, f"(?s)(.).{{0,{period - 1}}}", "$1")
    return kept if length is None else F.substring(kept, 1, length)


def shape_hash(window: Column, shape: str) -> Column:
    """Base-4 number of the window's letters at the shape's 1s (A=0 C=1 G=2 T=3)."""
    if not shape.startswith("1"):
        raise ValueError("a shape starts with 1")
    digits = F.concat(*(F.substring(F.translate(window, BASES, "0123"), i + 1, 1) for i, c in enumerate(shape) if c == "1"))
    return F.conv(digits, 4, 10).cast("long")


def spell(value: Column, length: int) -> Column:
    """DNA of a base-4 number, length letters (A=0 C=1 G=2 T=3)."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), length, "0"), "0123", BASES)


def hash_range(prefix: Column, q: int) -> Column:
    """struct(low, high): the base-4 numbers of the q-grams that start with a prefix of up to q letters are from low to high - 1."""
    step = F.pow(F.lit(4.0), q - F.length(prefix)).cast("long")
    low = F.when(F.length(prefix) == 0, F.lit(0).cast("long")).otherwise(F.conv(F.translate(prefix, BASES, "0123"), 4, 10).cast("long") * step)
    return F.struct(low.alias("low"), (low + step).alias("high"))


def hash_with_length(gram: Column, q: int) -> Column:
    """A number for texts of up to q letters: shorter ones before longer ones, each length by its base-4 number."""
    shorter = ((F.pow(F.lit(4.0), F.length(gram)) - 1) / 3).cast("long")
    return F.when(F.length(gram) <= q, shorter + F.coalesce(F.conv(F.nullif(F.translate(gram, BASES, "0123"), F.lit("")), 4, 10).cast("long"), F.lit(0)))


def end_high(s: Column) -> Column:
    """A key that orders texts with their end above every letter: AC comes after ACT."""
    return F.concat(s, F.lit("~"))


def replaced(s: Column, begin: Column, size: Column, with_: Column) -> Column:
    """s with size characters from begin (0-based) replaced: insertion where size is 0, erasure where with_ is empty."""
    return F.concat(F.left(s, begin), with_, F.substring(s, begin + size + 1, F.length(s)))


def fitted(s: Column, size: int, pad: str) -> Column:
    """s cut, or filled with pad, to size characters."""
    return F.rpad(F.left(s, F.lit(size)), size, pad)


# fixed values: alphabets in the order of their codes, as published for nucleic and amino acids
DNA5, IUPAC, AMINO = "ACGTN", "UTAWCYMHGKRDSBVN", "ARNDCQEGHILKMFPSTWYVBZX*"


def coded(c: Column, alphabet: str, unknown: str) -> Column:
    """A letter's code in an alphabet, either case; letters it lacks count as unknown."""
    at = F.instr(F.lit(alphabet), F.upper(c))
    return F.when((at > 0) & (F.length(c) == 1), at - 1).otherwise(alphabet.index(unknown)).cast("int")


# fixed values: published gapped seeds
SHAPES = {"patternhunter": "111010010100110111", "patternhunter2_1": "111101011101111", "patternhunter2_2": "1111000100010011010111"}
