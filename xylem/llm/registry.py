"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, langid, lm, media, mixing, near, packing, privacy, repeats

QUERIES = {
    "op1_brown_lm": lm.op1_brown_lm,
    "op2_packing_spfhp": packing.op2_packing_spfhp,
    "op3_chat_parts": chat.op3_chat_parts,
    "op4_recompression": repeats.op4_recompression,
    "op5_soft_mixing": mixing.op5_soft_mixing,
    "op6_pii_disclosure": privacy.op6_pii_disclosure,
    "op7_media_wav": media.op7_media_wav,
    "op8_minhash_oph": fingerprints.op8_minhash_oph,
    "op9_order_minhash": near.op9_order_minhash,
    "op10_langid_ppm": langid.op10_langid_ppm,
}

ORACLES: dict[str, str] = {"op3_chat_parts": chat.OP3_SQL, "op4_recompression": repeats.OP4_SQL}
