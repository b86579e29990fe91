"""Analytics over ordered chat and tool-call transcripts, expressed as Spark DataFrames."""
