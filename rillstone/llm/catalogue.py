"""The queries of this subpackage and their SQL equivalents."""

from . import audio, chat, lines, mixing, packing, pseudonyms, sketches, toxicity, vectors, webpages

QUERIES = {
    "op1_main_text": webpages.op1_main_text,
    "op2_embedding_links": vectors.op2_embedding_links,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_chat_format": chat.op4_chat_format,
    "op5_near_duplicates": sketches.op5_near_duplicates,
    "op6_media": audio.op6_media,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_pseudonyms": pseudonyms.op8_pseudonyms,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pack": packing.op10_pack,
}
ORACLES = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op7_line_dedup": lines.OP7_SQL,
}
