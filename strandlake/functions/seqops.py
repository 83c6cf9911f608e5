"""Sequence functions as Spark column expressions: no Python runs per row.

Bases are A, C, G, T; everything else ends a run. Column functions that take a k-mer
expect upper-case bases; `bases` and `acgt_runs` accept either case.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases that one chunk of a run starts k-mers at: substring by position costs time
#: in proportion to the position, so windows are cut from short chunks.
CHUNK = 256
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters mapped cyclically to bases, for tables of prose.
RECODED = ("ACGT" * 7)[:26] * 2


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(text, keep_breaks: bool = True) -> Column:
    """Prose as DNA: letters a-z and A-Z become ACGT cyclically. Other characters stay and act as breaks, or go."""
    dna = F.translate(col(text), _LETTERS, RECODED)
    return dna if keep_breaks else F.regexp_replace(dna, "[^ACGT]+", "")


def upper(seq) -> Column:
    """Bases in upper case; other characters, ASCII or not, stay as they are."""
    return F.translate(col(seq), "acgt", "ACGT")


def acgt_runs(seq) -> Column:
    """Array of maximal runs of bases, in order."""
    return F.regexp_extract_all(upper(seq), F.lit("[ACGT]+"), F.lit(0))


def complement(seq) -> Column:
    """Complement in upper case; what is no base becomes N."""
    return F.translate(F.regexp_replace(upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA")


def revcomp(kmer) -> Column:
    return F.reverse(F.translate(col(kmer), "ACGT", "TGCA"))


def canonical(kmer) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(col(kmer), revcomp(kmer))


def in_canonical_form(kmer) -> Column:
    return col(kmer) <= revcomp(kmer)


def same_vertex(a, b) -> Column:
    return canonical(a) == canonical(b)


def is_base(c) -> Column:
    return col(c).rlike("^[ACGTacgt]$")


def is_placeholder(c) -> Column:
    return ~is_base(c)


def base_code(c) -> Column:
    """0, 1, 2, 3 for A, C, G, T in either case; else null."""
    return F.when(is_base(c), F.translate(upper(c), "ACGT", "0123").cast("int"))


def code_base(code) -> Column:
    return F.translate(col(code).cast("string"), "0123", "ACGT")


def encode(kmer) -> Column:
    """A k-mer of at most 32 bases as a long, two bits a base, the last base lowest; the bits of 32 bases fill the sign too."""
    value = F.conv(F.translate(col(kmer), "ACGT", "0123"), 4, 10).cast("decimal(20,0)")
    return F.when(value > F.lit(2**63 - 1), value - F.lit(Decimal(2**64))).otherwise(value).cast("long")


def decode(value, k: int) -> Column:
    return F.translate(F.lpad(F.conv(F.hex(col(value)), 16, 4), k, "0"), "0123", "ACGT")


def pack_hex(kmer, k: int) -> Column:
    """Two bits a base, first base in the highest bits of the first byte, zero padded at the end; as hex text."""
    digits = F.rpad(F.translate(col(kmer), "ACGT", "0123"), -(-k // 4) * 4, "0")
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 4 * i, 4), 4, 16), 2, "0") for i in range(-(-k // 4))]
    return F.concat(*parts)


def pack(kmer, k: int) -> Column:
    return F.unhex(pack_hex(kmer, k))


def base_at(kmer, index: int, k: int) -> Column:
    """The base `index` places from the right, from 0."""
    return F.substring(col(kmer), k - index, 1)


def front(kmer) -> Column:
    return F.substring(col(kmer), 1, 1)


def back(kmer) -> Column:
    return F.right(col(kmer), F.lit(1))


def lmer_at(kmer, index: int, length: int) -> Column:
    """The part of `length` bases that starts `index` bases from the left."""
    return F.substring(col(kmer), index + 1, length)


def roll_next(kmer, base) -> Column:
    return F.concat(F.substr(col(kmer), F.lit(2)), col(base))


def roll_prev(kmer, base) -> Column:
    return F.concat(col(base), F.left(col(kmer), F.length(col(kmer)) - 1))


def from_prefix(edge) -> Column:
    """The first k bases of a (k+1)-mer."""
    return F.left(col(edge), F.length(col(edge)) - 1)


def from_suffix(edge) -> Column:
    return F.substr(col(edge), F.lit(2))


def base_reverse(kmer) -> Column:
    return F.reverse(col(kmer))


def count_of(seq, characters: str) -> Column:
    """How many characters of seq are among those given."""
    return (F.length(col(seq)) - F.length(F.translate(col(seq), characters, ""))).cast("long")


def count_non_acgt(seq) -> Column:
    return (F.length(col(seq)) - F.length(F.regexp_replace(col(seq), "[^ACGTacgt]", ""))).cast("long")


def mask_of(seq, non_acgt: bool = True) -> Column:
    """A string of 0 and 1: which characters are no bases, or are N."""
    if non_acgt:
        return F.regexp_replace(F.regexp_replace(col(seq), "[^ACGTacgt]", "1"), "[ACGTacgt]", "0")
    return F.regexp_replace(F.regexp_replace(col(seq), "[^Nn]", "0"), "[Nn]", "1")


def runs(df: DataFrame, seq: str = "seq", *keep: str) -> DataFrame:
    """keep..., run_id (from 0), run: one row for each run of bases."""
    return df.select(*keep, F.posexplode(acgt_runs(seq)).alias("run_id", "run"))


def kmers(df: DataFrame, k: int, *keep: str, run: str = "run") -> DataFrame:
    """keep..., pos (from 0), kmer: one row for each window of k bases of each run.

    Runs are cut into chunks that overlap by k - 1 bases before the windows are cut.
    """
    check_k(k)
    long = df.where(F.length(run) >= k)
    starts = F.sequence(F.lit(0), F.length(run) - k, F.lit(CHUNK))
    chunks = long.select(*keep, run, F.explode(starts).alias("_at"))
    chunks = chunks.select(*keep, "_at", F.substr(F.col(run), F.col("_at") + 1, F.lit(CHUNK + k - 1)).alias("_chunk"))
    places = F.sequence(F.lit(0), F.length("_chunk") - k)
    rows = chunks.select(*keep, "_at", "_chunk", F.explode(places).alias("_in"))
    return rows.select(*keep, (F.col("_at") + F.col("_in")).alias("pos"), F.substr(F.col("_chunk"), F.col("_in") + 1, F.lit(k)).alias("kmer"))


def check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or not 2 <= k <= 256:
        raise ValueError("k must be an integer from 2 to 256")


def check_km(k: int, m: int) -> None:
    check_k(k)
    if isinstance(m, bool) or not isinstance(m, int) or not 1 <= m <= 32 or m >= k:
        raise ValueError("m must be an integer from 1 to 32 and less than k")
