"""Training-data operators over a documents table (doc_id, text, ...).

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; `queries` derives the contract columns.
"""
