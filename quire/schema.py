"""Schemas of the library tables and of nested documents.

Chapters live in a long relation, one row each; arrays of chapters appear only
at the edges (``nest_chapters``).
"""

from pyspark.sql import types as T

CHAPTER = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())])
METADATA = T.StructType([T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("language", T.StringType())])

USERS = "id string, email string, created_at timestamp"
BOOKS = (
    "id string, user_id string, title string, author string, original_filename string, file_path string, file_size int, "
    "source_language string, upload_date timestamp, created_at timestamp, original_content variant, translation_status string, folder_id string"
)
#: ``provider`` is nullable: older rows have none.
TRANSLATIONS = "id string, epub_file_id string, user_id string, translated_content variant, target_language string, translation_status string, created_at timestamp, provider string"
FOLDERS = "id string, user_id string, name string, created_at timestamp"

#: What the container readers give: one row per chapter file.
CHAPTER_FILES = "book_id string, file_title string, author string, language string, chapter_idx int, path string, html string, listed_title string, parse_error string"

STATUSES = ("none", "translating", "completed")
DEFAULT_METADATA = {"title": "Unknown Title", "author": "Unknown Author", "language": "en"}
NO_CONTENT = "No content could be extracted from this {} file."
FAILED = "Error: Failed to parse {} file. The file may be corrupted or in an unsupported format."
