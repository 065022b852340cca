"""Training-data operators: text, token and embedding jobs over document tables.

Nothing outside this folder imports it; `queries.py` holds the registered queries.
"""
