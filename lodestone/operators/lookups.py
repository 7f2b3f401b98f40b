"""Point look-ups.  Each is a filter and a projection, so both reach the scan; where the
first of several counts, a total order says which that is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_by_filename(document: DataFrame, filename: str) -> DataFrame:
    return document.filter(F.col("filename") == filename).select("doc_id", "filename").orderBy("doc_id").limit(1)


def document_by_id(document: DataFrame, doc_id: int) -> DataFrame:
    return document.filter(F.col("doc_id") == doc_id).select("doc_id", "filename")


def body_by_id(document: DataFrame, doc_id: int) -> DataFrame:
    return document.filter(F.col("doc_id") == doc_id).select("body")


def documents_by_ids(document: DataFrame, doc_ids: Sequence[int]) -> DataFrame:
    """None for no ids."""
    return document.filter(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "filename")


def documents_by_filenames(document: DataFrame, filenames: Sequence[str]) -> DataFrame:
    return document.filter(F.col("filename").isin(list(filenames))).select("doc_id", "filename")


def token_by_term(token: DataFrame, term: str) -> DataFrame:
    return token.filter(F.col("term") == term).orderBy("token_id").limit(1)


def token_by_id(token: DataFrame, token_id: str) -> DataFrame:
    return token.filter(F.col("token_id") == token_id)


def tokens_by_terms(token: DataFrame, terms: Sequence[str]) -> DataFrame:
    return token.filter(F.col("term").isin(list(terms)))


def postings_by_terms(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """An index that is stored in order of terms is read in few row groups."""
    return index.filter(F.col("term").isin(list(terms)))


def symbols_by_name(symbol: DataFrame, name: str, package: str | None = None) -> DataFrame:
    some = symbol.filter(F.col("name") == name)
    return some if package is None else some.filter(F.col("package_name") == package)


def symbols_by_package(symbol: DataFrame, package: str) -> DataFrame:
    return symbol.filter(F.col("package_name") == package)


def packages_by_name(package: DataFrame, name: str) -> DataFrame:
    return package.filter(F.col("name") == name)


def definitions_of(symbol_definition: DataFrame, symbol_id: str) -> DataFrame:
    return symbol_definition.filter(F.col("symbol_id") == symbol_id)
