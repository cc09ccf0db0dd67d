"""hustings: DataFrame operators for contest results, opinion polls and their dimensions."""
