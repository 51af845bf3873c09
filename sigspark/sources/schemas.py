"""Fixed schemas of the stored tables, in DDL form."""

RECORDING = (
    "rec_id string, base_data string, path string, report string, orig_sf int, leads array<string>, ecg array<array<double>>"
)
SEGMENT = (
    "segment_key string, rec_id string, base_data string, seg_idx int, segment_len int, target_sf int, orig_sf int, "
    "report string, path string, exam_id string, tracing_idx int, ecg array<array<float>>"
)
TURNS = "array<struct<`from`:string,value:string>>"
INSTANCE = (
    "inst_id bigint, dataset string, name string, key string, conversations array<struct<`from`:string,value:string>>"
)
MAPPED = "ecg_path string, text string, name string"
VOCAB = "token_id int, symbols string"
MERGES = "rank int, left_id int, right_id int, token_id int, n bigint, symbols string"
TOKEN_VECTORS = "token_id int, vector array<float>, freq bigint"

# Columns of the corpus metadata files.
PTB_METADATA = "ecg_id int, filename_hr string, report string"
MIMIC_RECORDS = "subject_id bigint, study_id bigint, file_name string, path string"
MIMIC_MEASUREMENTS = (
    "subject_id bigint, study_id bigint, " + ", ".join(f"report_{i} string" for i in range(18))
)
PREPARED = "path string, report string"
