"""Named queries of the operators, and the SQL of those that SQL can express."""

from leakscan.llm.chat import SQL as CHAT_SQL
from leakscan.llm.chat import op4_chat
from leakscan.llm.digest import op7_digest
from leakscan.llm.divergence import SQL as DIVERGENCE_SQL
from leakscan.llm.divergence import op12_divergence
from leakscan.llm.extract import op5_extract
from leakscan.llm.language import op10_language
from leakscan.llm.lattice_lm import op1_lattice_lm
from leakscan.llm.order_minhash import op2_order_minhash
from leakscan.llm.packing import op6_packing
from leakscan.llm.prefix_bpe import op3_prefix_bpe
from leakscan.llm.quality import SQL as QUALITY_SQL
from leakscan.llm.quality import op8_quality
from leakscan.llm.vector_codes import SQL as CODES_SQL
from leakscan.llm.vector_codes import op11_codes
from leakscan.llm.warc import op9_warc
from leakscan.llm.window_packing import op13_windows

QUERIES = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_order_minhash": op2_order_minhash,
    "op3_prefix_bpe": op3_prefix_bpe,
    "op4_chat": op4_chat,
    "op5_extract": op5_extract,
    "op6_packing": op6_packing,
    "op7_digest": op7_digest,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_codes": op11_codes,
    "op12_divergence": op12_divergence,
    "op13_windows": op13_windows,
}

ORACLES = {"op4_chat": CHAT_SQL, "op8_quality": QUALITY_SQL, "op11_codes": CODES_SQL, "op12_divergence": DIVERGENCE_SQL}
