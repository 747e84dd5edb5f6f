"""Importing this module registers the queries of the subpackage."""

import vouch.llm.exact_dedup  # noqa: F401
import vouch.llm.licenses  # noqa: F401
import vouch.llm.simhash  # noqa: F401
import vouch.llm.bpe  # noqa: F401
import vouch.llm.packing  # noqa: F401
import vouch.llm.language  # noqa: F401
import vouch.llm.quality  # noqa: F401
import vouch.llm.pseudo_likelihood  # noqa: F401
import vouch.llm.pii  # noqa: F401
import vouch.llm.substring_dedup  # noqa: F401
import vouch.llm.alignment  # noqa: F401
import vouch.llm.periodic_runs  # noqa: F401
import vouch.llm.html_text  # noqa: F401
import corpus_pipeline  # noqa: F401
