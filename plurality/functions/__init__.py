from plurality.functions.hashing import (
    bucket_index, bucket_of_digest, keyed_text, lo64_hex, lo64_words, md5_lo64_decimal, md5_lo64_hex, uniform_of_digest, unit_uniform,
)
from plurality.functions.text import canonical, fingerprint, normalized_text

__all__ = [
    "bucket_index", "bucket_of_digest", "keyed_text", "lo64_hex", "lo64_words", "md5_lo64_decimal", "md5_lo64_hex", "uniform_of_digest",
    "unit_uniform", "canonical", "fingerprint", "normalized_text",
]
