"""Operators for preparing training corpora of language models.

Nothing else in the library imports this subpackage. Conventions that every
operator here keeps:

* a null text counts as the empty text; texts are processed whole;
* rows that repeat are rows like any others, unless an operator says otherwise;
* an empty table gives an empty result of the same schema;
* further columns of the input, whatever their names, never reach or disturb a
  result; where an operator returns input rows, they pass through unchanged.
"""
