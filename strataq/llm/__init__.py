"""Operators on texts and source code for training data. Nothing else in the library imports this package."""


def modules() -> list:
    """The modules with QUERIES and SQL."""
    from strataq.llm import queries_credentials, queries_functions, queries_leaks, queries_sentences, queries_syntax, queries_tokens

    return [queries_credentials, queries_tokens, queries_functions, queries_leaks, queries_sentences, queries_syntax]
