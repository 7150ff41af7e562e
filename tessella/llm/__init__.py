"""Training-data operators: near-dedup, scoring, filtering, tokenisation, sharding, archives and sanitisation.

Every operator lives in its own module with a DataFrame-in, DataFrame-out interface. `queries` lists the
thin queries over the standard tables. Nothing outside this subpackage imports it.
"""
