"""Analytics over conversation, memory, graph and event tables as Spark DataFrames."""
