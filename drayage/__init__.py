"""Delivery-operations analytics as Spark jobs.

``sources``   reads the input tables and derives the logistics mart from them
``functions`` column expressions (draws, costing, calendar, metrics)
``operators`` DataFrame-to-DataFrame steps (numbering, joins, expansion)
``plans``     the reports: dashboards, metrics, questions, planning, quality
``lifecycle`` build, document, summarise and drop the mart in a catalog
``oracle``    the same answers written as plain SQL, used only for checking
"""
