"""startlens: startup analytics on Spark.

Lazy DataFrame -> DataFrame operators for evaluating startups at any
scale: enrichment of company, funding-round and investment tables, venture
KPIs, a weighted 0-100 investment score, exact distributed ranking and
summaries, missing-data statistics, MLlib outcome models and prospect
scoring (batch and streaming).

Modules: ``functions`` (column helpers, fixed parameters), ``sources``
(scans, sinks, test fixtures), ``operators`` (the operators), ``plans``
(compositions, registered queries, oracle SQL, runs), ``streaming``.
"""

__version__ = "0.1.0"
