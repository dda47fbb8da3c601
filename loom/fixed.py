"""Fixed values.

These must equal the behaviour being reproduced; results depend on them.
They are stated once, here, in plain form.
"""

# --- fixed values (must match the reproduced behaviour) ---------------------------------
NUMERIC_TEXT = r"^[0-9.-]+$"      # a categorical column converts to numeric only if every value matches
IQR_FACTOR = 1.5                  # outlier fences: q1 - 1.5 * IQR, q3 + 1.5 * IQR (strictly outside)
QUALITATIVE_MAX_DISTINCT = 10     # numeric with at most 10 distinct values (NULL counted) is qualitative
HIST_BINS = 10                    # histogram bin width = range / 10
PAGE_SIZE = 10                    # browse page length
SUMMARY_DECIMALS = 3              # mean, SD and variance in the formatted summary
TARGET_DECIMALS = 2               # target statistics
STAT_DECIMALS = 3                 # Pearson r, correlation ratio, Cramer's V
HOLDOUT_SEED = 123                # holdout split seed
TRAIN_MIN, TRAIN_MAX = 0.50, 0.90 # allowed train proportion
SPLIT_SUM_TOLERANCE = 0.01        # train + test must be 1 within this
SVM_COST = 0.01                   # default SVM cost C
FOREST_TREES = 100                # default number of trees
TREE_DEPTH = 5                    # default decision-tree depth
TREE_MIN_LEAF = 7                 # minimum rows per tree node
