import datetime as dt

import pandas as pd


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days(start: str, count: int) -> list[dt.date]:
    return [day(start) + dt.timedelta(days=i) for i in range(count)]


def series(spark, rows, schema: str):
    return spark.createDataFrame(rows, schema)


def records(df, *order) -> list[dict]:
    frame = df.orderBy(*order) if order else df
    return [r.asDict() for r in frame.collect()]


def pandas(df, *order) -> pd.DataFrame:
    return (df.orderBy(*order) if order else df).toPandas()
