"""Tables of structure atoms (file, line_no, chain, resname, resnum, icode, bfactor).

A structure file numbers at most 99,999 atoms, so a window over one file is bounded by the format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Confidence limits.
CONFIDENT = 70.0
LOW = 50.0
# Residue names of DNA.
DNA_RESIDUES = ("DA", "DT", "DC", "DG", "A", "T", "C", "G")


def residues(atoms: DataFrame) -> DataFrame:
    """The first atom of every residue, of the lines long enough to hold a B-factor; residues whose number or B-factor is no
    number are left out."""
    first = atoms.where(~F.col("short") if "short" in atoms.columns else F.lit(True)).groupBy("file", "chain", "residue").agg(
        F.min_by(F.struct("line_no", "resnum", "bfactor"), "line_no").alias("a")).select(
        "file", "chain", "residue", "a.*")
    return first.where(F.col("resnum").isNotNull() & F.col("bfactor").isNotNull())


def low_segments(atoms: DataFrame) -> DataFrame:
    """Runs of consecutive residues of one chain below 50: file, segment, chain, start, end."""
    order = Window.partitionBy("file").orderBy("line_no")
    low = F.col("bfactor") < LOW
    follows = ((F.lag("chain").over(order) == F.col("chain")) & (F.lag("resnum").over(order) + 1 == F.col("resnum"))
               & (F.lag("bfactor").over(order) < LOW))
    rows = (residues(atoms).withColumn("_low", low)
            .withColumn("_opens", (low & ~F.coalesce(follows, F.lit(False))).cast("int"))
            .withColumn("segment", F.sum("_opens").over(order)).where("_low"))
    return rows.groupBy("file", "segment").agg(
        F.first(F.trim("chain")).alias("chain"), F.min_by("resnum", "line_no").alias("start"),
        F.max_by("resnum", "line_no").alias("end"))


def residue_confidence(atoms: DataFrame, listed: int | None = None) -> DataFrame:
    """Per file the shares of confident and of low residues, the low segments (the first `listed` of them) and their number."""
    shares = residues(atoms).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_residues"),
        F.round(F.avg((F.col("bfactor") >= CONFIDENT).cast("double")), 4).alias("fraction_confident"),
        F.round(F.avg((F.col("bfactor") < LOW).cast("double")), 4).alias("fraction_low"))
    all_ = F.sort_array(F.collect_list(F.struct("segment", "chain", "start", "end")))
    segments = low_segments(atoms).groupBy("file").agg(
        (all_ if listed is None else F.slice(all_, 1, listed)).alias("s"), F.count(F.lit(1)).alias("low_segments_total"))
    texts = F.transform("s", lambda x: F.concat_ws(":", x["chain"], x["start"].cast("string"), x["end"].cast("string")))
    return shares.join(segments, "file", "left").select(
        "file", "n_residues", "fraction_confident", "fraction_low",
        F.coalesce(texts, F.array().cast("array<string>")).alias("low_segments"),
        F.coalesce("low_segments_total", F.lit(0)).alias("low_segments_total"))


def dna_chains(atoms: DataFrame) -> DataFrame:
    """DNA chains: file, chain, bases (resnum and base in order) and their sequence; the last atom
    of a residue number decides its base."""
    dna = atoms.where(F.col("resname").isin(*DNA_RESIDUES) & F.col("resnum").isNotNull())
    base = F.substring(F.col("resname"), -1, 1)
    one = dna.groupBy("file", "chain", "resnum").agg(F.max_by(base, "line_no").alias("base"))
    return one.groupBy("file", "chain").agg(
        F.sort_array(F.collect_list(F.struct("resnum", "base"))).alias("bases")).withColumn(
        "sequence", F.array_join(F.transform("bases", lambda b: b["base"]), ""))


def has_dna(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("file").agg(F.bool_or(F.col("resname").isin(*DNA_RESIDUES)).alias("has_dna"))


def duplexes(atoms: DataFrame) -> DataFrame:
    """The two first chains of each file, by name, as forward and reverse strand."""
    ordered = F.sort_array(F.collect_list(F.struct("chain", "bases")))   # one entry per chain of a file
    return dna_chains(atoms).groupBy("file").agg(ordered.alias("c")).select(
        "file", F.get("c", F.lit(0))["chain"].alias("fwd_chain"), F.get("c", F.lit(0))["bases"].alias("fwd_bases"),
        F.get("c", F.lit(1))["chain"].alias("rev_chain"), F.get("c", F.lit(1))["bases"].alias("rev_bases"))
