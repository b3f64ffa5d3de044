from suite import catalogs, deployments, rows, schemas, texts

GROUPS = [rows, texts, schemas, deployments, catalogs]
