"""quillgrid: scholarly-document analytics on PySpark."""
