"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, licences, mixing, pii, quality_rules, simhash, subwords, templates, toxicity

QUERIES = {
    "op1_html_extraction": templates.op1_html_extraction,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_pii": pii.op4_pii,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_licences": licences.op8_licences,
    "op9_chat": chat.op9_chat,
    "op10_quality_classifier": subwords.op10_quality_classifier,
    "base_quality": quality_rules.base_quality,
    "base_licences": licences.base_licences,
}
ORACLE_SQL = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_chat": chat.OP9_SQL,
    "base_quality": quality_rules.BASE_SQL,
    "base_licences": licences.BASE_SQL,
}
