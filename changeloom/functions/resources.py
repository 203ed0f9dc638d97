"""Kinds of resources: which hold data, and which attributes replace a resource when they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds that hold data (fixed values).
STATEFUL = """
    aws_db_instance aws_rds_cluster aws_rds_cluster_instance aws_rds_global_cluster aws_dynamodb_table aws_dynamodb_global_table
    aws_s3_bucket aws_ebs_volume aws_efs_file_system aws_fsx_lustre_file_system aws_elasticache_cluster
    aws_elasticache_replication_group aws_sqs_queue aws_kinesis_stream aws_kms_key aws_route53_zone aws_redshift_cluster
    aws_docdb_cluster aws_neptune_cluster aws_msk_cluster aws_opensearch_domain aws_elasticsearch_domain aws_backup_vault
    aws_secretsmanager_secret aws_ecr_repository aws_glacier_vault aws_timestream_database aws_memorydb_cluster
    google_sql_database_instance google_sql_database google_storage_bucket google_compute_disk google_compute_region_disk
    google_bigquery_dataset google_bigquery_table google_spanner_instance google_spanner_database google_pubsub_topic
    google_pubsub_subscription google_kms_crypto_key google_kms_key_ring google_dns_managed_zone google_redis_instance
    google_filestore_instance google_firestore_database google_bigtable_instance google_alloydb_cluster
    azurerm_postgresql_server azurerm_postgresql_flexible_server azurerm_mysql_server azurerm_mysql_flexible_server
    azurerm_mssql_server azurerm_mssql_database azurerm_sql_database azurerm_cosmosdb_account azurerm_storage_account
    azurerm_storage_container azurerm_storage_share azurerm_managed_disk azurerm_key_vault azurerm_key_vault_key
    azurerm_dns_zone azurerm_redis_cache azurerm_servicebus_queue azurerm_servicebus_namespace azurerm_eventhub_namespace
    digitalocean_database_cluster digitalocean_volume digitalocean_spaces_bucket cloudflare_zone cloudflare_r2_bucket
    kubernetes_persistent_volume_claim kubernetes_persistent_volume kubernetes_stateful_set kubernetes_persistent_volume_claim_v1
    kubernetes_persistent_volume_v1 kubernetes_stateful_set_v1 nomad_csi_volume nomad_csi_volume_registration nomad_volume
    nomad_external_volume vault_mount consul_keys postgresql_database mysql_database mongodbatlas_cluster
    mongodbatlas_advanced_cluster StatefulSet PersistentVolumeClaim PersistentVolume
""".split()

#: Kind and attributes whose change usually replaces the resource; attributes below a listed one count with it (fixed values).
REPLACING = """
    aws_db_instance: engine identifier availability_zone db_subnet_group_name kms_key_id storage_encrypted username
    aws_rds_cluster: engine cluster_identifier availability_zones database_name kms_key_id storage_encrypted
    aws_instance: ami availability_zone subnet_id key_name user_data private_ip
    aws_s3_bucket: bucket bucket_prefix
    aws_dynamodb_table: name hash_key range_key
    aws_ebs_volume: availability_zone snapshot_id encrypted
    aws_efs_file_system: creation_token encrypted performance_mode
    aws_sqs_queue: name fifo_queue
    aws_elasticache_cluster: cluster_id engine subnet_group_name
    aws_kms_key: key_usage customer_master_key_spec
    aws_lambda_function: function_name
    aws_ecr_repository: name
    Deployment: spec.selector.matchLabels
    StatefulSet: spec.selector.matchLabels spec.serviceName spec.volumeClaimTemplates
    Service: spec.clusterIP
    PersistentVolumeClaim: spec.storageClassName spec.accessModes
"""
#: Starts of kinds, and their attributes that replace, alone and not what lies below (fixed values).
REPLACING_FAMILIES = """
    google_: name project region zone location
    azurerm_: name location resource_group_name
"""


def pairs(text: str) -> list[tuple[str, str]]:
    return [(line.split(":")[0].strip(), a) for line in text.strip().splitlines() for a in line.split(":")[1].split()]


def rules(spark: SparkSession) -> DataFrame:
    """kind, attribute, family (whether kind is only its start): the fixed values as a table, to which others can be added."""
    return spark.createDataFrame([(*p, False) for p in pairs(REPLACING)] + [(*p, True) for p in pairs(REPLACING_FAMILIES)], "kind string, attribute string, family boolean")


def stateful(kind: Column) -> Column:
    return kind.isin(STATEFUL)


def replaced(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """changes (kind, attribute, and others) with forces_new, by rules (kind, attribute, family).

    An attribute is opened to itself and the names that it lies in, and a kind to itself and its family (what stands before its first underscore, with that), so both
    meet the rules by equality. Null kinds and attributes force nothing.
    """
    from changeloom.operators.nested import ancestors

    listed = rules.where("NOT family").select("kind", F.col("attribute").alias("_above")).distinct()
    families = rules.where("family").select(F.col("kind").alias("_family"), "attribute").distinct()
    keys = changes.select("kind", "attribute").where("kind IS NOT NULL AND attribute IS NOT NULL").distinct()
    one = keys.withColumn("_above", F.explode(ancestors(F.col("attribute")))).join(listed, ["kind", "_above"], "left_semi").select("kind", "attribute")
    two = keys.withColumn("_family", F.regexp_extract("kind", "^[^_]*_", 0)).join(families, ["_family", "attribute"], "left_semi").select("kind", "attribute")
    hits = one.union(two).distinct().withColumn("_hit", F.lit(True))
    return changes.join(hits, ["kind", "attribute"], "left").withColumn("forces_new", F.coalesce("_hit", F.lit(False))).select(*changes.columns, "forces_new")
