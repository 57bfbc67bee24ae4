"""The queries of this subpackage and the SQL that DuckDB can run for them."""

from tallyspark.llm.decontaminate import OP10_SQL, op10_decontaminate
from tallyspark.llm.divergence import OP11_SQL, op11_source_divergence
from tallyspark.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from tallyspark.llm.html_extract import op9_html_extract
from tallyspark.llm.language_id import op5_language_id
from tallyspark.llm.mixing import OP4_SQL, op4_curriculum_mix
from tallyspark.llm.ngram_join import OP8_SQL, op8_ngram_jaccard
from tallyspark.llm.pii import op6_pii
from tallyspark.llm.piece_codec import op13_sentencepiece
from tallyspark.llm.quality import op1_quality
from tallyspark.llm.spelling import OP12_SQL, op12_spelling_variants
from tallyspark.llm.token_count import op3_token_count
from tallyspark.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_token_count": op3_token_count,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_html_extract": op9_html_extract,
    "op10_decontaminate": op10_decontaminate,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sentencepiece": op13_sentencepiece,
}
SQL = {
    "op2_warc": OP2_SQL, "op4_curriculum_mix": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_ngram_jaccard": OP8_SQL,
    "op10_decontaminate": OP10_SQL, "op11_source_divergence": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
