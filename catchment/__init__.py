"""catchment: retail trade-area analytics on Spark.

Stores attract postal codes by a gravity model (revenue over squared
great-circle distance).  The resulting shares weight demographic, newcomer
and social-value features into store profiles, which are compared with
banner, region and channel benchmarks; competition measures how shares
move when one banner (or channel, or customer group) leaves the market.

Everything is DataFrame / Spark SQL code built from native expressions.
"""

__version__ = "0.1.0"
