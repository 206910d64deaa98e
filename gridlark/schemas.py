"""Schemas of annotation documents, manifests and predictions."""

IMAGE = "id long, file_name string, width int, height int, flickr_url string, flickr_640_url string, coco_url string"
ANNOTATION = "id long, image_id long, category_id int, bbox array<double>, iscrowd int, area double, segmentation array<array<double>>"
CATEGORY = "id int, name string"
COCO = f"images array<struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>>, annotations array<struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>>, categories array<struct<{CATEGORY.replace(' ', ':').replace(',:', ',')}>>"
DETECTION = "class_id:int,class_name:string,confidence:double,xyxy:array<double>"
TRUTH = "class_id:int,xyxy:array<double>"
PER_IMAGE = f"image string, tp int, fp int, fn int, detections array<struct<{DETECTION}>>, truth array<struct<{TRUTH}>>"
GROUPS = "image_id string, group_id string, file_name string, basis string"
SPLIT_MANIFEST = "image_id string, file_name string, group_id string, split string, sha256 string, duplicate_of string"
TILES = "image_id string, source_file string, split string, output_file string, x string, y string, width string, height string, objects string"
