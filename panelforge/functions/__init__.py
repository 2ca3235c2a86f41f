from .exprs import (days_from, hash_percent, month_index, pairwise_corr,
                    series_label, sign_colour, smape_term)

__all__ = ["days_from", "hash_percent", "month_index", "pairwise_corr", "series_label",
           "sign_colour", "smape_term"]
