"""Names of plasmid features as category tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# For each category, in the order in which categories are tried, the tokens and the patterns that name them.
FEATURE_PATTERNS = (
    ("ELEM", (
        ("<ELEM_AAV_ITR>", ("AAV ITR", "AAV2 ITR", "adeno-associated virus ITR")),
        ("<ELEM_CMV_ENHANCER>", ("CMV enhancer", "CMV IE enhancer", "hr5 enhancer")),
        ("<ELEM_CMV_INTRON>", ("CMV intron", "CMV IE intron", "CMV intron A")),
        ("<ELEM_CPPT>", ("cPPT", "central polypurine tract", "CPPT/CTS")),
        ("<ELEM_GRNA_SCAFFOLD>", ("gRNA scaffold", "sgRNA scaffold", "tracrRNA scaffold", "Nm gRNA scaffold", "Fn gRNA scaffold", "Sa gRNA scaffold")),
        ("<ELEM_IRES>", ("IRES", "internal ribosome entry site", "EMCV IRES")),
        ("<ELEM_LTR_3>", ("3' LTR", "3' long terminal repeat", "LTR 3'", "3' LTR (ΔU3)")),
        ("<ELEM_LTR_5>", ("5' LTR", "5' long terminal repeat", "LTR 5'", "5' LTR (truncated)")),
        ("<ELEM_MCS>", ("MCS", "multiple cloning site", "polylinker", "multiple cloning region")),
        ("<ELEM_POLYA_BGH>", ("bGH poly(A)", "bovine growth hormone polyA", "BGH pA")),
        ("<ELEM_POLYA_SV40>", ("SV40 poly(A)", "SV40 late polyA", "SV40 pA signal", "SV40 poly(A) signal")),
        ("<ELEM_PSI>", ("psi", "Ψ", "packaging signal", "HIV packaging signal", "HIV-1 Ψ", "MESV Ψ", "MMLV Ψ", "Ad5 Ψ")),
        ("<ELEM_TRACRRNA>", ("tracrRNA", "trans-activating crRNA", "tracr", "Nm tracrRNA")),
        ("<ELEM_WPRE>", ("WPRE", "woodchuck hepatitis virus posttranscriptional regulatory element")),
    )),
    ("PROM", (
        ("<PROM_AMPR>", ("AmpR promoter",)),
        ("<PROM_CMV>", ("CMV promoter", "CMV IE94 promoter", "mCMV promoter", "CMV IE", "CMV_immearly")),
        ("<PROM_T5>", ("T5 promoter",)),
        ("<PROM_SV40>", ("SV40 promoter", "SV40 early promoter")),
        ("<PROM_LAC>", ("lac promoter", "tac promoter", "lac UV5 promoter", "lacI promoter")),
        ("<PROM_T7>", ("T7 promoter",)),
        ("<PROM_U6>", ("U6 promoter", "AtU6 promoter", "CeU6 promoter")),
        ("<PROM_EF1A>", ("EF-1α promoter", "EF-1α core promoter", "EF-1 promoter", "EF_1")),
        ("<PROM_RSV>", ("RSV promoter", "RSV LTR")),
        ("<PROM_SP6>", ("SP6 promoter",)),
        ("<PROM_CAG>", ("chicken β-actin promoter", "CAG promoter", "CBA promoter")),
        ("<PROM_T3>", ("T3 promoter",)),
    )),
    ("ORI", (
        ("<ORI_F1>", ("f1 ori", "f1_origin", "f1 phage ori", "F1 ori")),
        ("<ORI_SV40>", ("SV40 ori", "SV40_origin", "SV40 early ori")),
        ("<ORI_RSF>", ("RSF1010", "RSF ori", "RSF1010 oriV", "RSF1010 oriT")),
        ("<ORI_2MU>", ("2μ ori", "2u ori", "2 micron ori")),
        ("<ORI_P15A>", ("p15A ori", "p15A_origin")),
        ("<ORI_PSC101>", ("pSC101 ori", "pSC101_origin")),
        ("<ORI_COLE1>", ("ColE1", "pBR322", "pMB1", "ori")),
    )),
    ("REPORTER", (
        ("<REPORTER_EGFP>", ("EGFP", "enhanced GFP", "eGFP", "mEGFP", "yEGFP", "yeGFP", "rsEGFP2", "rsEGFP", "d1EGFP", "d2EGFP", "d4EGFP", "deGFP4", "cEGFP", "aceGFP")),
        ("<REPORTER_GFP>", ("GFP", "green fluorescent protein", "superfolder GFP", "GFP (S65T)", "GFPuv", "TurboGFP", "TagGFP", "EmGFP", "AcGFP1", "αGFP", "SGFP2", "roGFP2")),
        ("<REPORTER_MCHERRY>", ("mCherry", "PAmCherry")),
        ("<REPORTER_MEMERALD>", ("mEmerald",)),
        ("<REPORTER_NANOLUC>", ("NanoLuc", "nanoluciferase", "Nluc")),
        ("<REPORTER_YFP>", ("YFP", "yellow fluorescent protein", "Citrine", "EYFP", "LanYFP", "SYFP2", "TagYFP", "PhiYFP")),
    )),
    ("TAG", (
        ("<TAG_FLAG>", ("FLAG", "DYKDDDDK", "2xFLAG", "3xFLAG", "5xFLAG")),
        ("<TAG_GST>", ("GST", "glutathione S-transferase", "GST26_SCHJA")),
        ("<TAG_HA>", ("HA tag", "hemagglutinin tag", "YPYDVPDYA", "3xHA")),
        ("<TAG_HIS>", ("6xHis", "His tag", "hexahistidine", "HIS6", "10xHis")),
        ("<TAG_MYC>", ("Myc", "c-Myc", "EQKLISEEDL", "3xMyc", "13xMyc")),
        ("<TAG_NLS>", ("NLS", "nuclear localization signal", "SV40 NLS", "nucleoplasmin NLS")),
        ("<TAG_V5>", ("V5", "V5 tag", "GKPIPNPLLGLDST")),
    )),
    ("AMR", (
        ("<AMR_AMPICILLIN>", ("AmpR", "blaTEM", "TEM-116", "TEM-171", "TEM-181", "beta-lactamase")),
        ("<AMR_KANAMYCIN>", ("KanR", "kanMX", "nptII", "APH(3')", "NeoR/KanR")),
        ("<AMR_SPECTINOMYCIN>", ("SpecR", "spectinomycin", "aadA")),
        ("<AMR_CHLORAMPHENICOL>", ("CmR", "CAT", "cat", "CamR")),
        ("<AMR_GENTAMICIN>", ("GentR", "gentamicin", "aacC1", "aac(3)-Ia", "GmR")),
        ("<AMR_TETRACYCLINE>", ("TetR", "tetA", "tetM", "tetQ", "tetC", "tetL", "tetX", "TcR")),
        ("<AMR_ZEOCIN>", ("BleoR", "zeocin", "bleomycin")),
        ("<AMR_APRAMYCIN>", ("ApraR", "apramycin", "AAC(3)-IV", "AAC6")),
        ("<AMR_STREPTOMYCIN>", ("StrR", "streptomycin")),
        ("<AMR_HYGROMYCIN>", ("HygR", "hygromycin")),
        ("<AMR_PUROMYCIN>", ("PuroR", "puro")),
        ("<AMR_NEOMYCIN>", ("NeoR", "neomycin", "neo")),
        ("<AMR_BLASTICIDIN>", ("BSD", "bsr", "blasticidin")),
        ("<AMR_NOURSEOTHRICIN>", ("NatR", "nourseothricin")),
    )),
)
# Patterns that are tried before all others, with their tokens.
FEATURE_OVERRIDES = (("ampr promoter", "<PROM_AMPR>"), ("ampicillin resistance promoter", "<PROM_AMPR>"), ("cmv enhancer", "<ELEM_CMV_ENHANCER>"))
# Fixed value: patterns of up to so many letters match whole words only.
SHORT_PATTERN = 4
# Species and their tokens.
SPECIES = (
    ("Homo sapiens", "<SP_HUMAN>"), ("Mus musculus", "<SP_MOUSE>"), ("Rattus norvegicus", "<SP_RAT>"), ("Escherichia coli", "<SP_ECOLI>"), ("Saccharomyces cerevisiae", "<SP_YEAST>"),
    ("Drosophila melanogaster", "<SP_DROSOPHILA>"), ("Danio rerio", "<SP_ZEBRAFISH>"), ("Caenorhabditis elegans", "<SP_CELEGANS>"), ("synthetic construct", "<SP_SYNTHETIC>"), ("Synthetic", "<SP_SYNTHETIC>"),
)
# Promoters and the tokens that they drive; none for any coding one, and coding categories.
DRIVES = (
    ("<PROM_AMPR>", ("<AMR_AMPICILLIN>",)), ("<PROM_LAC>", None), ("<PROM_CMV>", None), ("<PROM_T7>", None), ("<PROM_T5>", None), ("<PROM_T3>", ()), ("<PROM_SV40>", None),
    ("<PROM_U6>", ()), ("<PROM_EF1A>", None), ("<PROM_RSV>", None), ("<PROM_SP6>", ()), ("<PROM_CAG>", None),
)
CODING = ("AMR", "REPORTER", "TAG")


def feature_rules() -> list[tuple[str, bool, str]]:
    """Lower-cased patterns, whether they match whole words only, and tokens, in the order in which they are tried."""
    out = [(p, False, t) for p, t in FEATURE_OVERRIDES]
    for _, tokens in FEATURE_PATTERNS:
        for token, patterns in tokens:
            out += [(p, len(p) <= SHORT_PATTERN, token) for p in dict.fromkeys(x.lower() for x in patterns)]
    return out


def feature_pattern(pattern: str, word: bool) -> str:
    """A rule as a regular expression of lower-cased names."""
    return rf"\b{re.escape(pattern)}\b" if word else re.escape(pattern)


def token_of_feature(name: Column) -> Column:
    """The token of the first rule that a feature's name fits; null if none does. Every pattern is a constant, most are plain substrings."""
    low = F.lower(name)
    fits = lambda p, word: low.rlike("(?U)" + feature_pattern(p, word)) if word else F.contains(low, F.lit(p))
    (p, word, token), *rest = feature_rules()
    out = F.when(fits(p, word), token)
    for p, word, token in rest:
        out = out.when(fits(p, word), token)
    return out


def map_features(df: DataFrame, name: str, token: str = "token") -> DataFrame:
    """df with the token of each feature's name. Distinct names, far fewer than rows, are matched and joined back; a null name has none."""
    names = df.select(name).distinct().where(F.col(name).isNotNull())
    return df.join(names.withColumn(token, token_of_feature(F.col(name))), name, "left")


def species_tokens(names: Column) -> Column:
    """Sorted distinct tokens of species names; unknown ones are left out."""
    known = F.create_map(*[F.lit(x) for pair in SPECIES for x in pair])
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.try_element_at(known, n)), lambda t: t.isNotNull())))


def drives(promoter: Column, coding: Column) -> Column:
    """Whether a promoter drives a coding token: one of its own, or any where it has none listed or isn't listed itself."""
    kind = F.split_part(F.translate(coding, "<>", ""), F.lit("_"), F.lit(1)).isin(*CODING)
    out = ~promoter.isin(*[p for p, own in DRIVES if own is not None])
    for p, own in DRIVES:
        if own:
            out = out | ((promoter == p) & coding.isin(*own))
    return kind & out
