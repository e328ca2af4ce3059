"""Variant records: clinical labels, coding consequences, single-base changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Clinical significance terms, matched as parts of the record's text.
PATHOGENIC = ("Pathogenic", "Likely_pathogenic", "Pathogenic/Likely_pathogenic")
BENIGN = ("Benign", "Likely_benign", "Benign/Likely_benign")

# Sequence Ontology labels and accessions of coding consequences.
CODING = (
    "missense_variant", "synonymous_variant", "stop_gained", "nonsense", "stop_lost", "start_lost",
    "frameshift_variant", "inframe_insertion", "inframe_deletion", "inframe_indel", "splice_acceptor_variant",
    "splice_donor_variant", "initiator_codon_variant", "initiatior_codon_variant",
    "SO:0001583", "SO:0001819", "SO:0001587", "SO:0001578", "SO:0002012", "SO:0001589", "SO:0001821",
    "SO:0001822", "SO:0001820", "SO:0001574", "SO:0001575", "SO:0001582",
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clinical_label(clinsig) -> Column:
    """pathogenic, then benign, by a term found anywhere in the text; NULL otherwise."""
    text = _c(clinsig)

    def names(terms):
        found = F.lit(False)
        for t in terms:
            found = found | text.contains(t)
        return found

    return F.when(names(PATHOGENIC), "pathogenic").when(names(BENIGN), "benign")


def is_coding(mc) -> Column:
    """True when a term of a consequence text is a coding one; false for NULL."""
    terms = F.transform(F.split(_c(mc), r"[,|]"), F.trim)
    return F.coalesce(F.arrays_overlap(terms, F.array(*[F.lit(c) for c in CODING])), F.lit(False))


def noncoding(df: DataFrame, mc: str = "mc", geneinfo: str | None = None) -> DataFrame:
    """Rows without a coding consequence; with geneinfo also gene, the text before ":" or "?"."""
    out = df.where(~is_coding(mc))
    if geneinfo is None:
        return out
    gene = F.substring_index(F.col(geneinfo), ":", 1)
    return out.withColumn("gene", F.when(F.coalesce(F.length(F.col(geneinfo)), F.lit(0)) > 0, gene).otherwise("?"))


def snv_only(df: DataFrame, ref: str = "ref", alts: str = "alts") -> DataFrame:
    """Records of one reference base whose alternatives are all one base; alt is the first."""
    ok = (F.length(ref) == 1) & (F.size(alts) > 0) & F.forall(alts, lambda a: F.coalesce(F.length(a) == 1, F.lit(False)))
    return df.where(F.col(ref).isNotNull() & F.col(alts).isNotNull() & ok).withColumn("alt", F.get(alts, F.lit(0)))
