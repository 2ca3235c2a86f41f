"""Parameter values shared across the library.

Fixed values: these equal the reference's settings, so results computed with
the defaults correspond to its analyses.  Operators take them as default
arguments; callers can override every one.
"""

# Fixed values (the reference's settings)
SEQUENCE_LENGTH = 8                 # input window of the sequence model
VALIDATION_LENGTH = 4               # held-out months / forecast horizon
ROLLING_WINDOW = 12                 # rolling mean / std window
SEASONAL_PERIOD = 12                # decomposition period and seasonal lag
MONTH_INDEX_ORIGIN = (2019, 8)      # month index 0 = August 2019
TOP_N_SERIES = 10                   # most / least correlated series shown
BEST_GROUPS = 6                     # groups in the best-groups mean error
SMAPE_SCALE = 200.0                 # SMAPE denominator (y + |p|) / 200
RF_NUM_TREES = 100                  # importance forest
RF_MAX_DEPTH = 4
RF_SEED = 42
TRAIN_PERCENT = 70                  # 70 / 30 split
SPLIT_SEED = 123                    # seed of the split and the folds
CV_FOLDS = 2
GBT_STEP = 0.1                      # learning rate of the boosted grid
GLOBAL_SEED = 1999                  # seed of the search over model settings
PCA_MAX_COMPONENTS = 9
PCA_CUTOFF = 0.95                   # explained-variance line on the scree plot
RF_GRID = {"numTrees": (50, 100, 150), "maxDepth": (5, 10, 15), "maxBins": (16, 32, 48)}
GBT_GRID = {"maxDepth": (2, 105), "maxBins": (16, 32), "maxIter": (10, 50, 100)}
SEARCH_TRIALS = 30                  # trials of the model-settings search
PATIENCE = 30                       # iterations without a better validation error
SERIES_FACTORS = (32, 64)           # numbers of a series' embedding
L2_CHOICES = (1e-5, 3e-5, 5e-5, 1e-6, 5e-6)

# Our own limits (not from the reference)
SPARK_MAX_TREE_DEPTH = 30           # Spark rejects deeper trees; 105 becomes 30
RF_BINS = 32                        # bins of the importance forest
LEAST_INFO_GAIN = 1e-9              # below it a boosted tree's gain is rounding of exhausted residuals
TREE_MEMORY_MB = 512                # histograms of a boosted tree that one pass may hold
