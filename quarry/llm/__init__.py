"""Operators of a training-data pipeline, and their queries."""

from quarry.llm import twins
from quarry.llm.bpe import op3_byte_bpe
from quarry.llm.fingerprints import op2_closed_syncmers
from quarry.llm.lm import op1_stupid_backoff
from quarry.llm.neardup import op5_minhash_components
from quarry.llm.packing import op10_cost_packing
from quarry.llm.pii import op4_disclosure_pii
from quarry.llm.quality import op8_quality_sketches
from quarry.llm.secrets import op6_credential_links
from quarry.llm.toxicity import op7_toxicity_lexicon
from quarry.llm.wavelet import op9_wavelet_shards

QUERIES = {
    f.__name__: f
    for f in (
        op1_stupid_backoff,
        op2_closed_syncmers,
        op3_byte_bpe,
        op4_disclosure_pii,
        op5_minhash_components,
        op6_credential_links,
        op7_toxicity_lexicon,
        op8_quality_sketches,
        op9_wavelet_shards,
        op10_cost_packing,
    )
}
#: Twins of those whose results SQL can tell whole. The others' fingerprints, ids, spans of terms, models and places are held against brute force by tests.
ORACLES: dict[str, str] = {"op1_stupid_backoff": twins.LM, "op5_minhash_components": twins.NEAR, "op8_quality_sketches": twins.QUALITY}
