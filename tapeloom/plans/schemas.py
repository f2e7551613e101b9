"""Fixed schemas of the tables, as DDL."""

METADATA = "job_id string, source_url string, title string, uploader string, asr_model string, chat_model string, chunk_seconds int, updated_at timestamp"
MANIFEST = "kind string, totalChunks int, chunkSeconds int, durationSeconds double, chunks array<string>, singleFile boolean, updatedAt string"
CHECKPOINT_PATCHES = "job_id string, seq long, patch map<string,string>"
CHUNK_RESULTS = "job_id string, chunk_idx int, text string, ingest_ts timestamp"
EVENTS = "job_id string, seq long, type string, step string, message string, progress double, transcript string, transcript_path string, title string, source_url string, error string"
STREAK_STATE = "startedAt string, relapses array<string>, updatedAt string"
DOWNLOAD_ATTEMPTS = "job_id string, strategy string, ok boolean, error string, ts timestamp"
TRANSCRIBE_ATTEMPTS = "job_id string, chunk_idx int, attempt int, error string"
