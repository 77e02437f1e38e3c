"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  On a cluster, ship ``weft`` to the
executors (``--py-files`` or an installed package): the Arrow functions import it there.
"""
