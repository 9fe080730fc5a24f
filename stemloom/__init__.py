"""stemloom: question-bank curation and text-corpus operators on PySpark."""
