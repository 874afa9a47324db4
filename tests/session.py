from pyspark.sql import SparkSession


def session():
    spark = (
        SparkSession.builder.master("local[8]").appName("spanlens-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
