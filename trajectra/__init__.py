"""trajectra: repeated-measures (panel) analytics on Spark.

Visit numbering, long/wide reshaping, panel description, growth-curve and
latent-class trajectory models fitted as distributed aggregations, per-subject
class scoring, and side-by-side comparison of fitted models.
"""

__version__ = "0.1.0"
