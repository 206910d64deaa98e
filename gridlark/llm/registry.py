"""The queries of this subpackage by name, and SQL where it can express them."""

from .conversation_repair import OP12_SQL, op12_conversation_repair
from .decontaminate import benchmark_template_classes, op8_decontaminate
from .embedding_dedup import OP2_SQL, op2_embedding_near_dedup
from .fingerprints import op13_document_fingerprints
from .html_extract import op4_html_extract
from .language_id import op10_language_id
from .license_scan import OP5_SQL, op5_license_scan
from .line_dedup import OP6_SQL, op6_line_dedup
from .ngram_join import OP9_SQL, op9_ngram_jaccard_join
from .quality_gam import op1_quality_gam
from .source_mix import OP7_SQL, op7_source_mix
from .token_order import op3_token_order
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_token_order": op3_token_order,
    "op4_html_extract": op4_html_extract,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_decontaminate": op8_decontaminate,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_document_fingerprints": op13_document_fingerprints,
    "benchmark_template_classes": benchmark_template_classes,
}

ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_source_mix": OP7_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
