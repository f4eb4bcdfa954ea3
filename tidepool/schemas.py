"""Fixed schemas of the file-sync data model."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("client_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("modified_time", T.LongType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("is_directory", T.BooleanType(), False),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("last_sync_time", T.LongType(), False),
    ]
)
FILE_COLS = [f.name for f in FILES.fields]

CHUNK_STORE = T.StructType(
    [
        T.StructField("hash_prefix", T.StringType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("size", T.IntegerType(), False),
        T.StructField("data", T.BinaryType(), True),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("index", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("size", T.IntegerType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("data", T.BinaryType(), True),
    ]
)

UPLOAD = T.StructType(
    [
        T.StructField("upload_id", T.StringType(), False),
        T.StructField("client_id", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("chunk", CHUNK, False),
        T.StructField("total_chunks", T.IntegerType(), False),
    ]
)
