"""Ad-click analytics on Spark DataFrames.

``sources``    schemas, readers, sinks and the shared scratch folder
``functions``  column expressions: scalar features, interest tags, hashing
``operators``  table operators: encoders, lookups, sampling, ANOVA, metrics
``plans``      models and the composite clean / train / predict jobs
``checks``     the registered queries and their independent SQL
"""
