"""The registered queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audio, chat, lm, mixing, packing, quality, sharding, simhash, urls, warc

QUERIES = {
    f.__name__: f
    for f in (
        lm.op1_lm_score,
        mixing.op2_mixing,
        urls.op3_url_filter,
        packing.op4_packing,
        simhash.op5_simhash,
        quality.op6_quality,
        audio.op7_audio,
        sharding.op8_sharding,
        warc.op9_warc,
        chat.op10_chat,
    )
}
ORACLE_SQL = {"op3_url_filter": urls.ORACLE, "op9_warc": warc.ORACLE, "op10_chat": chat.ORACLE}
