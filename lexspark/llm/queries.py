"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from . import chat, decontam, langid, licenses, mixing, orderminhash, sharding, simhash, suffixdedup, tokenids


def queries() -> dict:
    found = (licenses.op1_license_scan, sharding.op2_virtual_slots, mixing.op3_temperature_mix, chat.op4_chat_format, orderminhash.op5_order_minhash, tokenids.op6_token_ids, suffixdedup.op7_suffix_dedup, simhash.op8_simhash, decontam.op9_decontaminate, langid.op10_ppm_langid)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle_sql(), "op3_temperature_mix": mixing.OP3_SQL, "op4_chat_format": chat.OP4_SQL, "op9_decontaminate": decontam.OP9_SQL}
