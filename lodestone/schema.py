"""The relations of the code-search engine, and the shape of analyser output."""

from __future__ import annotations

DOCUMENT = "doc_id bigint, filename string, body string"
TOKEN = "token_id string, term string, kind int"
POSTING = "term string, doc_id bigint, positions array<int>"
#: Postings of a term in documents of one segment, in bytes: the least document, how many there are, the bytes' size before compression.
PACKED = "term string, segment bigint, doc_id bigint, n_docs int, size int, data binary"
SYMBOL = "symbol_id string, name string, package_name string"
PACKAGE = "package_id string, name string, system_id string"
SYMBOL_DEFINITION = "symbol_id string, specifier string, doc_id bigint, position int"
PACKAGE_DEFINITION = "package_id string, specifier string, doc_id bigint, position int"
ASD_SYSTEM = "system_id string, name string, doc_id bigint, analyzed_time double"
RESULT = "doc_id bigint, filename string, start int, end int, metadata map<string,string>"
SPEC = (
    "system_name string, asd_file string, root_directory string, files array<string>, "
    "definitions array<struct<identifier:struct<type:string,name:string,package:string>,locations:array<struct<specifier:string,file:string,position:int>>>>, time double"
)

#: Relations by name, as a store keeps them.
RELATIONS = {
    "document": DOCUMENT,
    "token": TOKEN,
    "inverted_index": POSTING,
    "symbol": SYMBOL,
    "package": PACKAGE,
    "symbol_definition": SYMBOL_DEFINITION,
    "package_definition": PACKAGE_DEFINITION,
    "asd_system": ASD_SYSTEM,
}
