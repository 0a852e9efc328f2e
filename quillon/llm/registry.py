"""The training-data queries by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from quillon.llm.op1_language import op1_language
from quillon.llm.op2_pii import op2_pii
from quillon.llm.op3_bpe import op3_bpe
from quillon.llm.op4_search import OP4_SQL, op4_search
from quillon.llm.op5_media import op5_media
from quillon.llm.op6_sharding import op6_sharding
from quillon.llm.op7_jaccard import OP7_SQL, op7_jaccard
from quillon.llm.op8_packing import op8_packing
from quillon.llm.op9_substrings import OP9_SQL, op9_substrings
from quillon.llm.op10_secrets import op10_secrets
from quillon.llm.op11_minhash import OP11_SQL, op11_minhash
from quillon.llm.op12_merkle import OP12_SQL, op12_merkle
from quillon.llm.op13_prefix_trie import OP13_SQL, op13_prefix_trie

QUERIES = {f.__name__: f for f in (op1_language, op2_pii, op3_bpe, op4_search, op5_media, op6_sharding, op7_jaccard, op8_packing, op9_substrings, op10_secrets, op11_minhash, op12_merkle, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op4_search": OP4_SQL, "op7_jaccard": OP7_SQL, "op9_substrings": OP9_SQL, "op11_minhash": OP11_SQL, "op12_merkle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
