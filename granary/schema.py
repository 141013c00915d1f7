"""Fixed schemas of the engine's tables, as DDL."""

MANIFEST = (
    "doc_id string, corp_code string, corp_name string, listed_name string, stock_code string, industry string, sector string, doc_group string, "
    "doc_subtype string, report_nm string, is_correction boolean, flr_nm string, rcept_no string, rcept_dt string, base_year int, base_month int, "
    "file_path string, file_format string, n_files int"
)

UNIVERSE = (
    "corp_code string, stock_code string, corp_name string, listed_name string, corp_eng_name string, market string, industry string, sector_no string, "
    "sector string, listing_date string, fiscal_month string, market_cap string, n_periodic string, n_major string, n_exchange string, n_holding string, note string"
)

CHUNK = (
    "chunk_id string, report_id string, parent_chunk_id string, text string, raw_text string, company string, corp_code string, report_type string, "
    "report_subtype string, report_name string, period string, filing_date string, section_path array<string>, content_type string, source_path string, "
    "is_correction boolean, correction_group_id string, correction_order int, is_latest boolean, field_codes map<string,string>"
)

#: A cell of a table, a pair of a key-value block, and a content node in document order.
CELL = "struct<text:string,is_header:boolean,field_code:string,unit_code:string,unit_value:string>"
PAIR = "struct<key:string,value:string,field_code:string,unit_code:string>"
NODE = (
    f"doc_id string, doc_group string, report_subtype string, source_path string, document_name string, section_seq int, section_title string, section_level int, "
    f"section_path array<string>, node_seq int, kind string, text string, title_hint string, unit_hint string, acode_group string, rows array<array<{CELL}>>, "
    f"group_label string, pairs array<{PAIR}>"
)
WARNING = "doc_id string, report_subtype string, source_path string, warning string"
