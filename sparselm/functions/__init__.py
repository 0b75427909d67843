from .vectors import (dot, drop_positions, pair_index, pair_products, soft_threshold,
                      soft_threshold_array, sq_norm, to_double_array, vadd, vscale, vsub)

__all__ = ["dot", "drop_positions", "pair_index", "pair_products", "soft_threshold",
           "soft_threshold_array", "sq_norm", "to_double_array", "vadd", "vscale", "vsub"]
