"""All queries of this subpackage and their SQL."""

import fieldmark.llm.byte_bpe  # noqa: F401
import fieldmark.llm.packing  # noqa: F401
import fieldmark.llm.token_files  # noqa: F401
from fieldmark.llm.common import ORACLES, QUERIES  # noqa: F401
import fieldmark.llm.simhash  # noqa: F401
import fieldmark.llm.near_vectors  # noqa: F401
import fieldmark.llm.neighbours  # noqa: F401
import fieldmark.llm.language  # noqa: F401
import fieldmark.llm.quality  # noqa: F401
import fieldmark.llm.line_dedup  # noqa: F401
import fieldmark.llm.repeats  # noqa: F401
import fieldmark.llm.alignment  # noqa: F401
import fieldmark.llm.prefix_trie  # noqa: F401
import fieldmark.llm.quality_rules  # noqa: F401
