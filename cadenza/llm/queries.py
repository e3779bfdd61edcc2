"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, idfiles, lexical, licences, line_dedup, negatives, neighbours, packing, quality, quotes, shards, simhash, url_rules

QUERIES = {
    "op1_url_rules": url_rules.op1_url_rules,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_quotes": quotes.op3_quotes,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality": quality.op5_quality,
    "op6_shards": shards.op6_shards,
    "op7_packing": packing.op7_packing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_licences": licences.op10_licences,
    "op11_lexical": lexical.op11_lexical,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_id_files": idfiles.op13_id_files,
}

SQL = {
    "op1_url_rules": url_rules.OP1_SQL,
    "op3_quotes": quotes.OP3_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_licences": licences.OP10_SQL,
    "op11_lexical": lexical.OP11_SQL,
}
