"""All registered queries of this package."""

from webtrail.llm import (  # noqa: F401
    alignment,
    decontamination,
    embeddings,
    exact_dedup,
    html,
    language,
    licenses,
    ngram_join,
    pieces,
    pii,
    prefix_trie,
    quality,
    warc,
)
from webtrail.llm.common import QUERIES  # noqa: F401
