"""Functions as Column expressions, so that the optimizer sees through them."""

from .aggregates import amount_range, amount_range_parts, multiset_digest, row_digest
from .arrays import add_one_deep, add_one_flat, add_one_list, add_one_row_major, checksum_deep, decode_dictionary, decode_runs
from .registry import FUNCTIONS, Volatility, register_functions
from .scalars import append_suffix, approx_equal, byte_length, days_since_epoch, first_word, number_prefix, strict_decimal, wrapping_add
from .lookups import async_lookup, region_multiplier

__all__ = [
    "FUNCTIONS", "Volatility", "add_one_deep", "add_one_flat", "add_one_list", "add_one_row_major", "amount_range", "amount_range_parts", "append_suffix",
    "approx_equal", "async_lookup", "byte_length", "checksum_deep", "days_since_epoch", "decode_dictionary", "decode_runs", "first_word", "multiset_digest",
    "number_prefix", "region_multiplier", "register_functions", "row_digest", "strict_decimal", "wrapping_add",
]
