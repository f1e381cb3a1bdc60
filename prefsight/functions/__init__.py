from prefsight.functions.core import (  # noqa: F401
    BIN_EDGES,
    N_BINS,
    calibration_bin,
    dot,
    hash_key,
    ieee_div,
    lit_vector,
    py_strip,
    safe_div,
    sigmoid,
    softplus_neg,
    sq_norm,
    vec_sub,
)
