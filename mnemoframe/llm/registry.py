"""The queries of this subpackage. Those without SQL have no counterpart in it: see their tests."""

from __future__ import annotations

import corpus_pipeline
from mnemoframe.llm.decontaminate import op5_decontaminate
from mnemoframe.llm.langid import op4_langid
from mnemoframe.llm.lexical import OP13_SQL, op13_lexical
from mnemoframe.llm.line_dedup import op6_line_dedup
from mnemoframe.llm.lm_scores import op12_lm_scores
from mnemoframe.llm.packing import op9_packing
from mnemoframe.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from mnemoframe.llm.quality import op2_quality
from mnemoframe.llm.simhash import op3_simhash
from mnemoframe.llm.token_counts import op10_token_counts
from mnemoframe.llm.token_files import op1_token_files
from mnemoframe.llm.warc import op8_warc
from mnemoframe.llm.winnow import op7_winnow


def queries() -> dict:
    found = (op1_token_files, op2_quality, op3_simhash, op4_langid, op5_decontaminate, op6_line_dedup, op7_winnow, op8_warc, op9_packing, op10_token_counts, op11_prefix_trie, op12_lm_scores, op13_lexical)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op11_prefix_trie": OP11_SQL, "op13_lexical": OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
