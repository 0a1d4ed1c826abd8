"""Operators: DataFrame in, DataFrame out, with explicit columns.

All are lazy but for those that stage a table (see ``weekpanel.session.stage``): row numbers and running totals
(``ranking``) and what builds on them, because row positions must be fixed before they are used; counts that
several branches read (``activity.staged_counts``), because the messages should be read once; and the small side
of joins on keys that may be hot.
"""
