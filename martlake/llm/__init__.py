"""Operators for training-text pipelines. Nothing else in the library imports this subpackage.

Conventions shared by the operators:

* the input is a DataFrame with at least an id column and a text column; other columns, whatever their
  names, are ignored or carried by the caller;
* a null text counts as an empty text unless an operator says otherwise;
* repeated rows and repeated ids are separate rows: the output has one row for each input row;
* every intermediate table is written below ``spark.checkpoint.dir`` (see :mod:`martlake.llm.common`).
"""
