"""Operations of a training-data pipeline over a table of documents.

Documents have the columns doc_id, text, lang, source and n_chars; operators use the
columns that they name and carry any others through untouched.
"""
