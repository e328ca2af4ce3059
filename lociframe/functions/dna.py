"""DNA text as Spark columns: every function takes and returns a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_acgt(col) -> Column:
    """True for a non-empty text of A, C, G, T in either case."""
    col = _c(col)
    return (F.length(col) > 0) & (F.translate(col, "ACGTacgt", "") == "")


def has_only_acgt(col) -> Column:
    """True when an upper-case text, possibly empty, has no other letter than A, C, G, T."""
    return F.translate(_c(col), "ACGT", "") == ""


def revcomp(col) -> Column:
    """Reverse complement; letters other than A, C, G, T are kept in place."""
    return F.reverse(F.translate(_c(col), "ACGTacgt", "TGCAtgca"))


def gc_content(col) -> Column:
    """Share of G and C, 0 for an empty text."""
    col = _c(col)
    n = F.length(col)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.translate(col, "GC", ""))) / n)


def one_hot(col) -> Column:
    """array<float> of 4 values per base in the order A, C, G, T; other letters give four zeros."""
    letters = F.filter(F.split(F.upper(_c(col)), ""), lambda b: b != "")
    return F.flatten(F.transform(
        letters, lambda b: F.array(*[(b == x).cast("float") for x in BASES])))


def from_one_hot(col) -> Column:
    """The base with the largest of each four values, the first on ties."""
    col = _c(col)
    n = (F.size(col) / 4).cast("int")

    def base(i):
        four = F.slice(col, i * 4 + 1, 4)
        best = F.array_position(four, F.array_max(four)).cast("int")
        return F.substring(F.lit("ACGT"), best, F.lit(1))

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, base), "")


def pad_n(col, length) -> Column:
    """Pad on the right with N up to length; longer texts are kept whole."""
    col = _c(col)
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(F.length(col) >= n, col).otherwise(F.rpad(col, n, F.lit("N")))


def center_trim(col, length: int) -> Column:
    """The middle length bases of a longer text; NULL for a shorter one."""
    col = _c(col)
    start = F.floor((F.length(col) - length) / 2).cast("int") + 1
    return F.when(F.length(col) >= length, F.substring(col, start, F.lit(length)))


def add_context(col, left: str, right: str, length: int) -> Column:
    """Constant flanks around an insert; an error when the alphabet or the total length is wrong."""
    full = F.concat(F.lit(left), _c(col), F.lit(right))
    return (F.when(F.translate(full, "ACGT", "") != "",
                   F.raise_error(F.concat(F.lit("letters other than A, C, G, T in "), full))
                   .cast("string"))
            .when(F.length(full) != length,
                  F.raise_error(F.concat(F.lit(f"length is not {length}: "), full)).cast("string"))
            .otherwise(full))


def substitute(col, offset, ref, alt) -> Column:
    """Put alt in the place of ref, which starts at the 0-based offset."""
    offset = F.lit(offset) if isinstance(offset, int) else _c(offset)
    return F.overlay(_c(col), _c(alt), (offset + 1).cast("int"), F.length(_c(ref)))


def insert_motif(col, motif: str, start: int | None = None) -> Column:
    """Overwrite bases with the motif at start, by default in the centre."""
    col = _c(col)
    at = (F.lit(start) if start is not None
          else F.floor((F.length(col) - len(motif)) / 2).cast("int"))
    fits = (at >= 0) & (at + len(motif) <= F.length(col))
    return F.when(fits, F.overlay(col, F.lit(motif.upper()), at + 1, F.lit(len(motif))))


def substitution_list(template, target, chain) -> Column:
    """Comma-joined substitutions that turn a template strand into a target.

    template is an array of (resnum, base) structs; an entry reads base, chain, residue, new base
    with lower-case bases.
    """
    target = F.upper(_c(target))
    letters = F.filter(F.split(target, ""), lambda b: b != "")
    template = _c(template)
    n = F.least(F.size(template), F.size(letters))
    pairs = F.zip_with(
        F.slice(template, 1, n), F.slice(letters, 1, n),
        lambda t, b: F.struct(t["resnum"].alias("resnum"), t["base"].alias("base"), b.alias("new")))
    changed = F.filter(pairs, lambda p: p["base"] != p["new"])
    return F.array_join(F.transform(changed, lambda p: F.concat(
        F.lower(p["base"]), _c(chain), p["resnum"].cast("string"), F.lower(p["new"]))), ",")


def duplex_substitutions(fwd, fwd_chain, rev, rev_chain, target) -> Column:
    """Substitutions for both strands of a duplex, closed by ";"; NULL when nothing changes."""
    a = substitution_list(fwd, target, fwd_chain)
    b = F.when(F.size(_c(rev)) > 0, substitution_list(rev, revcomp(F.upper(_c(target))), rev_chain))
    both = F.array_join(F.filter(F.array(a, F.coalesce(b, F.lit(""))), lambda x: x != ""), ",")
    return F.when(both != "", F.concat(both, F.lit(";")))


def expand_n(df: DataFrame, col: str, out: str = "expanded") -> DataFrame:
    """One row per concrete sequence of a text with N: 4^k rows for k Ns, numbered by variant."""
    seq = F.upper(F.trim(F.col(col)))
    k = F.length(seq) - F.length(F.translate(seq, "N", ""))
    checked = df.withColumn(
        "_seq", F.when(F.translate(seq, "ACGTN", "") != "",
                       F.raise_error(F.concat(F.lit("letters other than A, C, G, T, N in "), seq))
                       .cast("string")).otherwise(seq))
    rows = checked.withColumn(
        "variant", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4.0), k).cast("long") - 1)))
    parts = F.split(F.col("_seq"), "N", -1)
    pieces = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(
        F.substring(F.lit("ACGT"),
                    (F.floor(F.col("variant") / F.pow(F.lit(4.0), F.size(parts) - 1 - i)) % 4)
                    .cast("int") + 1, F.lit(1)), p)))
    return rows.withColumn(out, F.array_join(pieces, "")).drop("_seq")


CHUNKS = (1 << 14, 1 << 9)


def as_bytes(col) -> Column:
    """A sequence as binary, one byte per base: substring then costs its own length only, while that
    of a string walks from the start. Letters outside ASCII become N."""
    col = _c(col)
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(
        F.regexp_replace(col, r"[^\x00-\x7F]", "N")).cast("binary")


def cut(data, start, length) -> Column:
    """Bases out of a binary sequence, start 0-based."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(_c(data), (start + 1).cast("int"), length).cast("string")


def chunked(df: DataFrame, col: str, width: int, sizes: tuple[int, ...] = CHUNKS) -> DataFrame:
    """The sequences as binary chunks (_at, _text), in place of the column, that overlap so that every window lies in just one as a start."""
    rows = (df.where(F.length(F.col(col)) >= width).withColumn("_at", F.lit(0))
            .withColumn("_text", as_bytes(col)).drop(col))
    for size in sizes:
        size = max(size, width)
        last = F.octet_length("_text") - width
        rows = (rows.withColumn("_off", F.explode(F.sequence(F.lit(0), last, F.lit(size))))
                .withColumn("_text", F.substring(F.col("_text"), F.col("_off") + 1, F.lit(size + width - 1)))
                .withColumn("_at", F.col("_at") + F.col("_off")))
    return rows.drop("_off")


def tile(df: DataFrame, col: str, width: int, step: int = 1, skip_n: bool = True,
         start: str = "win_start", out: str = "win") -> DataFrame:
    """One row per window of a sequence column; windows with another letter than A, C, G, T dropped.

    A long sequence is first cut into overlapping chunks and the windows are cut from those, so the
    cost grows with the length and not with its square. The sequence column itself is dropped
    from the rows.
    """
    rows = chunked(df, col, width)
    first = F.pmod(-F.col("_at"), F.lit(step))
    last = F.octet_length("_text") - width
    rows = (rows.where(first <= last)
            .withColumn("_off", F.explode(F.sequence(first, last, F.lit(step))))
            .withColumn(start, F.col("_at") + F.col("_off"))
            .withColumn(out, cut("_text", F.col("_off"), width))
            .drop("_at", "_text", "_off"))
    return rows.where(has_only_acgt(out)) if skip_n else rows


def kmer_counts(df: DataFrame, key: str, col: str, k: int, skip_n: bool = True) -> DataFrame:
    """Counts of the overlapping k-mers of each sequence."""
    return (tile(df.select(key, col), col, k, skip_n=skip_n, out="kmer")
            .groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n")))


def add_revcomp(df: DataFrame, col: str = "seq", flag: str = "is_rc") -> DataFrame:
    """Each row and its reverse complement, in the same split, in one pass over df."""
    rows = df.withColumn(flag, F.explode(F.array(F.lit(False), F.lit(True))))
    return rows.withColumn(col, F.when(F.col(flag), revcomp(col)).otherwise(F.col(col)))


def random_dna(key, length: int, seed) -> Column:
    """length bases decided by md5(seed:key:block), equal in every engine and on every retry."""
    blocks = -(-length // 32)
    text = F.concat_ws("", *[
        F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"), F.lit(f":{i}"))) for i in range(blocks)])
    return F.substring(F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGT"), 1, length)


def fill_n(col, key, seed) -> Column:
    """Each N replaced by a base decided by md5(seed:key:piece number)."""
    parts = F.split(_c(col), "N", -1)
    key = _c(key).cast("string")

    def piece(p, i):
        code = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), i.cast("string"))), 1, 1)
        return F.when(i == 0, p).otherwise(
            F.concat(F.translate(code, "0123456789abcdef", "ACGTACGTACGTACGT"), p))

    return F.array_join(F.transform(parts, piece), "")


def validate_dna(df: DataFrame, key: str, col: str = "seq") -> DataFrame:
    """One row: counts, the offender with the smallest key, and whether all lengths are equal."""
    bad = ~F.coalesce(is_acgt(col), F.lit(False))
    n = F.length(F.col(col)).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_bad"),
        F.min(F.when(bad, F.col(key))).alias("first_bad"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"),
    ).withColumn("one_length", F.col("min_length") == F.col("max_length"))
