"""munim: bank-statement analytics as PySpark DataFrame jobs.

Every public function is either ``Column -> Column`` (``munim.functions``) or
``DataFrame -> DataFrame`` (``munim.sources``, ``munim.operators``).  All tables
carry ``statement_id`` so that any number of statements run in one job.
"""

__version__ = "0.1.0"
