"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it
can be imported. Conventions shared by all operators:

* They read only the columns they name, so extra columns never clash. Working columns of a
  join against a caller's frame start with ``__op_``.
* Text that is null counts as empty. Rows without an id cannot be referred to, so an operator
  that returns rows per id leaves them out; a filter over whole rows keeps them.
* Word work runs on the UTF-8 buffers of Arrow batches with numpy (``arrays``). Spark does the
  partitioning, shuffling and joining.
"""
