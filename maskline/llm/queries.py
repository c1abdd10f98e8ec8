"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, filter_audit, lexical, warc
from .bpe import op12_bpe_codec
from .chat import op8_chat_format
from .decontaminate import op3_decontaminate
from .filter_audit import op13_filter_audit
from .fingerprint import op2_fingerprint
from .lexical import op11_lexical_search
from .line_quality import op6_line_quality
from .packing import op5_best_fit_packing
from .phrase_dedup import op9_phrase_dedup
from .simhash_near import op10_simhash_near
from .suffix_dedup import op7_suffix_dedup
from .toxicity import op1_toxicity
from .warc import op4_warc_revisit

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_fingerprint,
        op3_decontaminate,
        op4_warc_revisit,
        op5_best_fit_packing,
        op6_line_quality,
        op7_suffix_dedup,
        op8_chat_format,
        op9_phrase_dedup,
        op10_simhash_near,
        op11_lexical_search,
        op12_bpe_codec,
        op13_filter_audit,
    )
}
SQL: dict[str, str] = {"op4_warc_revisit": warc.SQL, "op8_chat_format": chat.SQL, "op11_lexical_search": lexical.SQL, "op13_filter_audit": filter_audit.SQL}
