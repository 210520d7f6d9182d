"""The tables: columns, keys, and what of them is published."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 8
_KINDS = {"t": T.StringType(), "i": T.LongType(), "r": T.DoubleType(), "a": T.ArrayType(T.StringType()), "m": T.MapType(T.StringType(), T.StringType()), "e": T.MapType(T.StringType(), T.DoubleType()), "h": T.ArrayType(T.ArrayType(T.DoubleType()))}


def _table(key: str, columns: str) -> tuple[list[str], T.StructType]:
    """``columns``: name, or name:kind for another kind than text. Flags stay 0, 1 or null."""
    fields = [(*c.split(":"), "t")[:2] for c in columns.split()]
    return key.split(), T.StructType([T.StructField(n, _KINDS[k], n not in key.split()) for n, k in fields])


TABLES: dict[str, tuple[list[str], T.StructType]] = {
    "meta_schema": _table("key", "key value"),
    "doc_document": _table("document_id", "document_id source_path source_rel source_name work_date date_source n_pages:i status error warning created_at received_at work_requested:i work_done:i"),
    "doc_page": _table("page_id", "page_id document_id page_no:i template_name classify_margin:r align_inliers:i align_grid_err:r align_ok:i aligned_image homography:h render_dpi:i print_sha variant_errs:e rotation:i duplicate_of duplicate_sim:r work_date status error"),
    "doc_field": _table("field_id", "field_id page_id region row_no:i field_name kind format row_key x0:i y0:i x1:i y1:i ink:r has_value_raw:i has_value:i value_raw value_final confidence:r candidates:a backend review_status status_raw reviewed_by reviewed_at"),
    "doc_page_meta": _table("page_id meta_key", "page_id meta_key value source field_id machine_value machine_confidence:r machine_status check_result"),
    "doc_review": _table("review_id", "review_id field_id page_id seq:i verdict value reviewer reviewed_at note source template region field_name row_no:i row_key x0:i y0:i x1:i y1:i machine_has_value:i machine_value_raw machine_backend machine_confidence:r"),
    "doc_decision": _table("decision_id", "decision_id seq:i target document_id page_no:i kind value decided_by decided_at note"),
    "doc_page_sig": _table("page_id", "page_id document_id family work_date sig"),
    "eq_equipment": _table("equipment_id", "equipment_id equipment_key hid site_category iso_type oem model registration active:i"),
    "eq_assignment_obs": _table("work_date slot", "work_date slot vehicle_no operator header_vehicle_no header_operator matched_by header_mismatch:i"),
    "insp_daily": _table("inspection_id", "inspection_id inspection_date equipment_id abnormal:i remark entry_source page_id source_field_id review_status"),
    "prod_haul": _table("haul_id", "haul_id work_date source_form source_role page_id slot vehicle_no operator material level shift has_value_raw:i has_value:i trips:i trips_raw:i confidence:r source_field_id review_status"),
    "xcheck_haul": _table("work_date slot material level", "work_date slot material level operator vehicle_no log_has:i matrix_has:i log_trips:i matrix_trips:i log_trips_raw:i matrix_trips_raw:i status"),
    "eq_usage_daily": _table("page_id", "page_id work_date source_form equipment equipment_id operator reading_kind meter_start:r meter_end:r meter_total:r clock_start clock_end meter_start_raw meter_end_raw meter_total_raw shifts:m shift_minutes:i activity_rows:i signed:i hours:r hours_basis start_field_id end_field_id total_field_id review_status"),
    "prod_tally": _table("tally_id", "tally_id work_date page_id source_form equipment equipment_id item place column_name shift is_subtotal:i has_value_raw:i has_value:i count:i count_raw:i confidence:r source_field_id review_status"),
    "xcheck_usage": _table("page_id check_kind item", "page_id check_kind item work_date equipment_ref value_a:r value_b:r diff:r days_between:i result other_page_id field_a field_b"),
}

#: Tables by the scope that publishes them; the column that names a date scope.
DOCUMENT_TABLES = ["doc_document", "doc_page", "doc_field", "doc_page_meta", "eq_usage_daily", "prod_tally", "xcheck_usage"]
DATE_TABLES = {"insp_daily": "inspection_date", "prod_haul": "work_date", "xcheck_haul": "work_date", "eq_assignment_obs": "work_date"}
WHOLE_TABLES = ["eq_equipment"]
NOT_PUBLISHED = {"created_at", "received_at", "work_requested", "work_done", "source_path"}
#: Columns that an upsert sets on insertion only.
INSERT_ONLY = {"doc_document": ["received_at", "created_at"]}


def keys(table: str) -> list[str]:
    return TABLES[table][0]


def schema(table: str) -> T.StructType:
    return TABLES[table][1]


def published(table: str) -> list[str]:
    return [f.name for f in schema(table) if f.name not in NOT_PUBLISHED]


def check_version(found: str | int | None) -> None:
    """Tables of another version are refused, not migrated."""
    if str(found) != str(SCHEMA_VERSION):
        raise ValueError(f"tables of schema version {found}; this is {SCHEMA_VERSION}")


_SQL_TYPES = {"string": "TEXT", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "binary": "BYTEA"}


def ddl(table: str, target_schema: str = "public") -> str:
    """CREATE TABLE for a relational target: widened types, the key, no foreign keys; nested values as text."""
    own = [f for f in schema(table) if f.name in published(table)]
    cols = ", ".join(f'"{f.name}" {_SQL_TYPES.get(f.dataType.simpleString(), "TEXT")}{"" if f.nullable else " NOT NULL"}' for f in own)
    key = ", ".join(f'"{k}"' for k in keys(table))
    return f'CREATE TABLE IF NOT EXISTS "{target_schema}"."{table}" ({cols}, PRIMARY KEY ({key}))'
