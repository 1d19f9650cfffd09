"""affinis: ligand-based target prediction and the data work around it, as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function.  Sub-packages:

* ``sources``   readers and writers with declared schemas
* ``functions`` column expressions (units, bins, similarity kernels, statistics)
* ``operators`` relational operators (curation, pairs, sampling, similarity, evaluation)
* ``plans``     registered queries, each with the SQL that must give the same rows
* ``streaming`` incremental scoring of newly arrived rows
"""

__version__ = "0.1.0"
