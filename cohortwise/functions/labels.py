"""Fixed vocabularies: codes in the data and the words used for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alteration token -> coverage type recorded per sample.
COVERAGE_TYPE = {
    "mutation": "MUTATION_EXTENDED",
    "amplification": "COPY_NUMBER_ALTERATION",
    "deep_deletion": "COPY_NUMBER_ALTERATION",
    "structural_variant": "STRUCTURAL_VARIANT",
}

# Mutation classes over `mutation_type`.
MUTATION_CLASSES = {
    "missense": ["Missense_Mutation"],
    "nonsense": ["Nonsense_Mutation"],
    "synonymous": ["Silent"],
    "splice": ["Splice_Site"],
    "frameshift": ["Frame_Shift_Ins", "Frame_Shift_Del"],
    "inframe_indel": ["In_Frame_Ins", "In_Frame_Del"],
    "truncating": ["Nonsense_Mutation", "Frame_Shift_Ins", "Frame_Shift_Del", "Splice_Site", "Nonstop_Mutation"],
    "point_mutation": ["Missense_Mutation", "Nonsense_Mutation", "Silent", "Splice_Site"],
}

# Copy-number levels.
CNA_LABELS = {
    -2: "Deep Deletion",
    -1: "Shallow Deletion",
    0: "Diploid",
    1: "Gain",
    2: "Amplification",
}

# Profile types of each family of continuous values.
PROFILE_FAMILIES = {
    "mRNA expression": ["mrna", "mrna_median_Zscores", "mrna_seq_v2_rsem", "mrna_seq_v2_rsem_Zscores",
                        "mrna_seq_cpm", "mrna_seq_fpkm", "mrna_U133", "mrna_outliers"],
    "Copy number": ["cna", "linear_CNA", "log2CNA", "cna_consensus", "cna_rae", "gistic"],
    "Methylation": ["methylation_hm27", "methylation_hm450", "methylation_epic", "methylation_promoters_rrbs"],
    "miRNA": ["mirna", "mirna_median_Zscores"],
    "Protein": ["protein_quantification", "protein_level", "RPPA"],
}

# Words for a data type -> `genetic_alteration_type`.
ALTERATION_WORDS = {
    "mutation": "MUTATION_EXTENDED",
    "mutations": "MUTATION_EXTENDED",
    "copy-number": "COPY_NUMBER_ALTERATION",
    "cna": "COPY_NUMBER_ALTERATION",
    "amplification": "COPY_NUMBER_ALTERATION",
    "deletion": "COPY_NUMBER_ALTERATION",
    "mrna expression": "MRNA_EXPRESSION",
    "protein expression": "PROTEIN_LEVEL",
    "rppa": "PROTEIN_LEVEL",
    "methylation": "METHYLATION",
    "structural variant": "STRUCTURAL_VARIANT",
    "fusion": "STRUCTURAL_VARIANT",
}

# Patterns in a study id -> source of the study.
STUDY_SOURCES = {
    "tcga": ["_tcga_"],
    "msk": ["_msk_", "^msk_"],
    "clonal_hematopoiesis": ["_ch_"],
    "target": ["_target_"],
    "genie": ["_genie_", "^genie_"],
    "pan_cancer_atlas": ["_pan_can_"],
}


def _lookup(column: Column, mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[column]


def in_mutation_class(column: Column | str, name: str) -> Column:
    """Whether a `mutation_type` belongs to a class; a type may be in several classes."""
    return (F.col(column) if isinstance(column, str) else column).isin(MUTATION_CLASSES[name])


def mutation_classes(column: Column | str) -> Column:
    """Array of all classes a `mutation_type` belongs to, in the order of MUTATION_CLASSES."""
    return F.array_compact(F.array(*[F.when(in_mutation_class(column, c), c) for c in MUTATION_CLASSES]))


def cna_label(column: Column | str) -> Column:
    """Name of a copy-number level -2..2; NULL for anything else."""
    return _lookup(F.col(column) if isinstance(column, str) else column, CNA_LABELS)


def profile_family(column: Column | str) -> Column:
    """Family of a profile type; NULL when it is not in the list."""
    families = {p: family for family, types in PROFILE_FAMILIES.items() for p in types}
    return _lookup(F.col(column) if isinstance(column, str) else column, families)


def alteration_type(column: Column | str) -> Column:
    """`genetic_alteration_type` for a data-type word, ignoring case; NULL when unknown."""
    return _lookup(F.lower(F.col(column) if isinstance(column, str) else column), ALTERATION_WORDS)


def study_sources(column: Column | str) -> Column:
    """Array of sources an id points at; several may hold."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    return F.array_compact(F.array(*[F.when(text.rlike("|".join(p)), name) for name, p in STUDY_SOURCES.items()]))
