"""Queries of the corpus operators, one for each, with production parameters over whole tables."""

from xylem.llm.archive import OP8_SQL, op8_warc
from xylem.llm.decontaminate import OP2_SQL, op2_decontamination
from xylem.llm.jaccard import OP4_SQL, op4_jaccard_join
from xylem.llm.language import op9_language
from xylem.llm.personal import op3_personal_data
from xylem.llm.pieces import op1_sentencepiece
from xylem.llm.quality import op6_quality
from xylem.llm.secrets import op5_secrets
from xylem.llm.spots import op7_fingerprints, spots_near_duplicates
from xylem.llm.toxicity import op10_toxicity


def queries():
    return {f.__name__: f for f in (op1_sentencepiece, op2_decontamination, op3_personal_data, op4_jaccard_join, op5_secrets, op6_quality, op7_fingerprints, op8_warc, op9_language, op10_toxicity, spots_near_duplicates)}


def oracle_sql():
    return {"op2_decontamination": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op8_warc": OP8_SQL}
