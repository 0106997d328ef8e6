"""Operators for training-data pipelines over large document tables.

Nothing else in the library imports this subpackage. On a cluster the executors import it like the rest of the
package (``--py-files`` or an installed package); ``frames.ready`` does that for local sessions.
"""
