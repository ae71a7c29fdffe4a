"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import chat, decontam, html, interleave, langid, mixing, pjpeg, simhash, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_langid": langid.op2,
    "op3_decontam": decontam.op3,
    "op4_chat": chat.op4,
    "op5_pjpeg": pjpeg.op5,
    "op6_html": html.op6,
    "op7_mixing": mixing.op7,
    "op8_interleave": interleave.op8,
    "op9_warc": warc.op9,
    "op10_simhash": simhash.op10,
}

SQL: dict[str, str] = {
    "op3_decontam": decontam.OP3_SQL,
    "op4_chat": chat.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_interleave": interleave.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
}
