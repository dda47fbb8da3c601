from .apply import FittedPrep, apply_prep, fit_prep

__all__ = ["FittedPrep", "apply_prep", "fit_prep"]
