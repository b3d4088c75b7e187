"""quillwork: spelling-pair and text-correction analytics on Spark DataFrames."""
